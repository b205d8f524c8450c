"""Fixed values that results depend on."""

# Prompt sentences and answer-extraction sentences.
STEP_SENTENCE = " Let's think step by step."
CAREFUL_SENTENCE = " Let's think step by step, being careful to notice and fix any mistakes."
ANSWER_SUFFIX = " Therefore, the answer (arabic numerals) is"
DIRECT_SUFFIX = "The answer (arabic numerals) is"
LOGPROB_SUFFIX = "\nThe answer is:"
END_OF_TEXT = "<|endoftext|>"

# Default task set of each data set, and the error type an error position stands for.
DEFAULT_TASKSETS = {"awps": "MultiArith", "asdiv": "ASDiv", "svamp": "SVAMP", "gsm8k": "test"}
ERROR_TYPES = {"any": "copying", "copy": "copying", "calc": "calculation", "propcalc": "calculation"}
BUILT_IN_TASKSETS = {
    "gsm8k": ("test", "test_socratic", "train", "train_socratic"),
    "svamp": ("SVAMP",),
    "asdiv": ("ASDiv",),
    "awps": ("AddSub", "MultiArith", "SingleOp"),
}

# Model names by provider, chat models, and limits per minute (requests, tokens) by family.
TOGETHER_MODELS = ["meta-llama/Llama-3-8b-chat-hf", "meta-llama/Llama-3-70b-chat-hf"]
ANTHROPIC_MODELS = ["claude-3-opus-20240229", "claude-3-sonnet-20240229", "claude-3-haiku-20240307"]
CHAT_MODELS = [
    "gpt-4", "gpt-4-0314", "gpt-4-0613", "gpt-4-32k", "gpt-4-32k-0314", "gpt-4-32k-0613",
    "gpt-3.5-turbo", "gpt-3.5-turbo-0301", "gpt-3.5-turbo-0613", "gpt-3.5-turbo-16k",
    "gpt-3.5-turbo-16k-0613", "gpt-4-1106-preview",
]
RATE_LIMITS = {"gpt-4": (10000, 300000), "claude": (4000, 400000), "chat": (10000, 2000000), "text": (3000, 250000)}
MAX_TOKENS = 500
MAX_STEP_NUMBER = 9999
PAGE_SIZE = 100
SAMPLE_SIZE = 300

# Every blank that Python's str.strip removes (by rule), and the same set as a regex class body.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
BLANK_CLASS = r"\t-\r\x1c-\x20\x85\p{Z}"

LETTERS = "abcdefghijklmnopqrstuvwxyz"
