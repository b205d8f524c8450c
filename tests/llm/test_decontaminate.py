import re

from slipmark.llm.decontaminate import decontaminate, find_leaks

ITEM = "A farmer sells 12 crates of apples to Maria for 3.50 dollars each and walks 7 km home before he counts the money he made."
OTHER = "The quick brown fox jumps over the lazy dog while seven small birds sing a very long song."


def test_planted(spark):
    filler = "some other words that stand around the passage "
    texts = {
        1: filler + ITEM + filler, 2: filler + ITEM.replace("12", "45").replace("Maria", "Peter").replace("7 km", "9 miles"),
        3: filler, 4: None, 5: "", 6: re.sub(r"[^\w\s.]", " ", ITEM), 7: "A farmer sells 12 crates of apples.", 8: ITEM + ITEM, 9: "tiny item here",
    }
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()] + [(1, texts[1], 5), (None, ITEM, 6)], "doc_id long, text string, share long")
    bench = spark.createDataFrame([(10, ITEM), (11, OTHER), (12, ITEM), (13, None), (14, ""), (15, "Tiny item here"), (None, ITEM)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in find_leaks(docs, bench).collect()}
    assert got == {(d, i): d != 2 for d in (1, 2, 6, 8) for i in (10, 12)} | {(9, 15): True}
    assert sorted(r.share for r in decontaminate(docs, bench).collect()) == [0] * 4
    assert find_leaks(docs.limit(0), bench).count() == 0 and find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate(docs, bench.limit(0)).count() == docs.count()


def found(spark, texts, items):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id): r.exact for r in find_leaks(docs, bench).collect()}


BOOKS = "Every day Anna reads 5 books then Anna lends 5 books to people whom Anna knows and 5 stay with her at home"


def test_slots_that_disagree_cost_their_windows_only(spark):
    texts = [
        BOOKS.replace("Anna", "Carla").replace("5", "8"),
        BOOKS.replace("stay with", "stay 6 with").replace("5 stay", "9 stay"),  # a literal copy but for one number
        BOOKS.replace("Every day Anna", "Every day Berta").replace("Anna knows", "Clara knows").replace("Anna lends", "Doris lends")
        .replace("reads 5", "reads 6").replace("lends 5", "lends 7").replace("5 stay", "8 stay"),  # no two values fit
    ]
    assert found(spark, texts, [BOOKS]) == {(0, 0): False, (1, 0): True}


def test_one_changed_number_in_a_long_copy(spark):
    item = "In all there are 5 red marbles and 5 blue marbles in the large bag that we keep under the old table here"
    assert found(spark, [item.replace("5 blue", "6 blue")], [item]) == {(0, 0): False}


def test_short_items_and_items_of_slots_alone(spark):
    items = ["What is 12 + 30?", "NAME THE CAPITAL CITIES OF FRANCE AND SPAIN AND PERU", "Anna Berta Carla Doris 1 2 3 4 5 6"]
    texts = [f"before that {t.lower()} and after it" for t in items] + ["what is 13 + 31?", "name the capital cities"]
    assert found(spark, texts, items) == {(i, i): True for i in range(3)}


def test_quoted_inside_a_sentence_and_lower_cased(spark):
    items = ["Maria walks along the river with Peter today", ITEM]
    texts = ["they said that Maria walks along the river with Peter today", ITEM.lower(), ITEM.upper()]
    assert found(spark, texts, items) == {(0, 0): True, (1, 1): True, (2, 1): True}


def test_a_phrase_of_all_items_brings_no_pairs(spark):
    phrase = "please read the question below with great care and then answer it in one short line"
    items = [f"{phrase} " + " ".join(f"w{i}x{j}" for j in range(30)) for i in range(30)]
    texts = [f"{phrase} nothing else {i}" for i in range(50)] + items[:3]
    assert found(spark, texts, items) == {(50 + i, i): True for i in range(3)}


def test_re_parameterised_copies_equal_a_plain_search(spark):
    """Against a plain version of the whole result: all windows of all pairs, with the same rules."""
    import random
    from collections import Counter, defaultdict

    draw = random.Random(6)
    words = "the cat sells buys red box with many small books near a river then walks home again and counts all of them".split()
    names = ["Anna", "Berta", "Carla", "Doris"]

    def sentence():
        out = [draw.choice(words)]
        for _ in range(draw.randrange(3, 26)):
            kind = draw.random()
            out.append(draw.choice(names) if kind < 0.12 else str(draw.randrange(2, 9)) if kind < 0.26 else draw.choice(words))
        return out

    items = [sentence() for _ in range(25)]

    def changed(tokens, rate):
        swap = {n: draw.choice(names) for n in names} | {str(n): str(draw.randrange(2, 9)) for n in range(2, 9)}
        return [draw.choice(words) if draw.random() < rate else swap.get(t, t) for t in tokens]

    texts = [sentence() + changed(draw.choice(items), draw.choice([0, 0, 0.05, 0.2])) + sentence() for _ in range(80)]

    def windows(tokens, sizes):
        low = [t.lower() for t in tokens]
        slot = [t.isdigit() or (t in names and i > 0) for i, t in enumerate(tokens)]
        mask = ["#" if t.isdigit() else "@" if s else t.lower() for t, s in zip(tokens, slot)]
        out = []
        for size in sizes:
            for i in range(len(tokens) - size + 1):
                held = sum(slot[i : i + size])
                out.append((i, tuple(low[i : i + size]), held, ()))
                if held and size - held >= min(4, size):
                    out.append((i, tuple(mask[i : i + size]), held, tuple((j, low[j]) for j in range(i, i + size) if slot[j])))
        return out

    want = set()
    for k, item in enumerate(items):
        asked = windows(item, [min(8, len(item))])
        places, typed = {w[0] for w in asked}, {w[0] for w in asked if w[3] or not w[2]}
        for d, text in enumerate(texts):
            shifts = defaultdict(list)
            for i, tokens, _, slots in windows(text, [min(8, len(item))]):
                for at, mine, _, own in asked:
                    if mine == tokens and len(own) == len(slots):
                        shifts[i - at].append((at, frozenset((p, a, b) for (p, a), (_, b) in zip(own, slots))))
            plain, any_way = set(), set()
            for group in shifts.values():
                counts = Counter((a, b) for _, a, b in {m for _, met in group for m in met})
                bound = {}
                for (a, b), n in counts.items():
                    bound[a] = max(bound.get(a, (0, "")), (n, b))
                for at, met in group:
                    if all(a == b for _, a, b in met) or all(bound[a][1] == b for _, a, b in met):
                        any_way.add(at)
                        if not met:
                            plain.add(at)
            if len(plain) >= 0.6 * len(places) or (typed and len(any_way & typed) >= 0.6 * len(typed)):
                want.add((d, k))
    got = found(spark, [" ".join(t) for t in texts], [" ".join(t) for t in items])
    assert len(want) > 40 and set(got) == want


def test_given_documents(spark):
    """All texts that hold a whole item, word by word, and no text that shares less than four words in a row."""
    folder = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = {r.item_id: words(r.text) for r in bench.collect()}
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    assert want == {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()}
