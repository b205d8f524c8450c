"""Column functions: prompts, scoring, number edits, letter noise, messages, run names."""
