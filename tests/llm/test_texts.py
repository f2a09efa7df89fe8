import random

import pytest

from lumenfold.llm import leaks as L
from lumenfold.llm import packing as P
from lumenfold.llm import splitting as S
from lumenfold.llm.tokens import VOCABULARY, counter, token_counts

DOCS = "doc_id long, text string, lang string, item_id long, cells array<struct<cell_no:int,cell_type:string,execution_count:int,char_from:int,char_to:int>>"
ITEM = "The keeper of the Brittle sawmill reports that 413 sacks vanish each thaw before a quarry filters the rest."
WORDS = "the keeper of the brittle sawmill reports that 413 sacks vanish each".split()


@pytest.mark.parametrize(
    "text, hit",
    [
        ("x " + " ".join(WORDS) + " y", True),
        (" ".join(WORDS[:11]), False),
        (" ".join(WORDS[:6] + ["very"] + WORDS[6:]), False),
        ("> The **keeper** of\n> the `Brittle` sawmill,\n> reports (that) 413 sacks vanish each", True),
        ("# the keeper\n# of the brittle sawmill reports that 413 sacks vanish each", True),
        ("the&nbsp;keeper of&#32;the &quot;brittle&quot; sawmill reports that 413 sacks vanish each", True),
        ('{"source": "the keeper\\nof the\\tbrittle \\u0073awmill reports \\"that\\" 413 sacks vanish each"}', True),
        ("the keeper \x1b[31mof the\x1b[0m brit​tle saw­mill reports that 413 sacks vanish each", True),
        ("ｔｈｅ　ｋｅｅｐｅｒ of the brittle sawmill reports that ４１３ sacks vanish each", True),
        ("the <b>keep</b>er of the <i class='x'>brittle</i> sawmill<br>reports that 413 sacks vanish each", True),
        ("the\\u001b[31m keeper of the brittle sawmill reports that 413 sacks vanish each", True),
        ("", False),
        (None, False),
    ],
)
def test_readings(text, hit):
    assert (L.ShiftSearch([(7, ITEM), (8, "too short to count")]).search(text) == {7}) is hit


def test_search_against_force():
    rng = random.Random(11)
    vocab = "a b c d e".split()
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(3, 20)))) for i in range(40)] + [(99, None)]
    s = L.ShiftSearch(items, 6)
    for _ in range(60):
        text = " ".join(rng.choices(vocab, k=rng.randint(0, 400)))
        want = {i for i, t in items if t and any(f" {' '.join(t.split()[k : k + 6])} " in f" {text} " for k in range(len(t.split()) - 5))}
        assert s.search(text) == want


def test_leaks_frame(spark):
    rows = [(1, "pre " + ITEM, None, 5, None), (2, None, None, None, None), (3, "", None, None, None), (1, "pre " + ITEM, None, 5, None), (4, "x " * 200_000 + ITEM, "en", 1, None)]
    got = L.find_leaks(spark.createDataFrame(rows, DOCS), [(7, ITEM), (None, ITEM), (9, None)]).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 7), (4, 7)]
    assert L.find_leaks(spark.createDataFrame([], DOCS), [(7, ITEM)]).count() == 0


def texts():
    rng = random.Random(12)
    words = ["alpha", "beta,", "gamma.", "delta!\n", "\n\nPart", "x=1;", "été", "漢字。", "   ", "\t", "🙂", "don't"]
    out = ["", "a", " ", "\n" * 3000, "z" * 9000, "漢" * 3000, "Zm9vYmFy" * 900, "a\n\n\n  b " * 700]
    return out + [" ".join(rng.choices(words, k=rng.randint(1, 3000))) for _ in range(30)]


@pytest.mark.parametrize("limit, overlap", [(64, 8), (200, 0), (500, 100), (3, 0)])
def test_split_round_trip(limit, overlap):
    c = counter(VOCABULARY)
    for text in texts():
        if limit == 3:
            text = text[:500]
        pieces = S._within(text, [len(text) // 3, len(text) // 2] if len(text) > 10 else [], c, limit, overlap)
        at = 0
        for start, core, end, n in pieces:
            assert core == at and start <= core and (end > core or not text) and (overlap or start == core)
            # a character of several tokens is never cut
            assert n == c.count(text[start:end]) and (n <= limit or end - core == 1)
            at = end
        assert at == len(text)
        if c.count(text) <= limit:
            assert len(pieces) == 1
    with_overlap = S._within("word " * 5000, [], c, 200, 40)
    assert all(abs(c.count(("word " * 5000)[s:k]) - 40) <= 2 for s, k, _, _ in with_overlap[1:])


def test_cells_come_first():
    c = counter(VOCABULARY)
    text = "one two three. " * 60
    cell = 447
    pieces = S.split_text(text, [cell], c, 200, 0)
    assert cell in {p[2] for p in pieces}


def test_split_frame(spark):
    rows = [(1, "word " * 3000, None, 1, [(1, "code", None, 0, 7000), (2, None, 1, 7000, None), None]), (2, "", "en", None, []), (3, None, None, None, None), (None, "x", None, None, None), (4, "short", None, None, None)]
    got = S.split_documents(spark.createDataFrame(rows, DOCS), 256, 32).orderBy("doc_id", "piece_no").collect()
    assert {r.doc_id for r in got} == {1, 2, 4} and all(r.n_tokens <= 256 for r in got)
    assert [r.piece_text for r in got if r.doc_id == 4] == ["short"] and [r.char_to for r in got if r.doc_id == 2] == [0]
    with pytest.raises(ValueError):
        S.split_documents(spark.createDataFrame(rows, DOCS), 10, 10)
    assert {r.doc_id: r.n_tokens for r in token_counts(spark.createDataFrame(rows, DOCS)).collect()}[4] == 1


def check(items, boxes, capacity):
    size = dict(items)
    assert sorted(i for i, _ in boxes) == sorted(size)
    load = {}
    for i, b in boxes:
        load[b] = load.get(b, 0) + size[i]
    assert all(v <= capacity for v in load.values())
    return len(load)


@pytest.mark.parametrize("kind", ["mixed", "equal", "halves", "one", "none"])
def test_pack(spark, kind):
    rng = random.Random(13)
    sizes = {"mixed": [min(1000, int(rng.paretovariate(1.1) * 20)) for _ in range(600)], "equal": [300] * 200, "halves": [500] * 51 + [501] * 20, "one": [0], "none": []}[kind]
    items = list(enumerate(sizes))
    df = spark.createDataFrame(items, "item long, size long")
    boxes = [(r.item, r.container) for r in P.pack(df, 1000).collect()]
    n = check(items, boxes, 1000)
    best = {"equal": 67, "halves": 46, "one": 1, "none": 0}.get(kind)
    assert n == best if best is not None else n <= 1.05 * -(-sum(sizes) // 1000) + 1


def best_fit(sizes, capacity):
    """Containers that one sequential best-fit pass over falling sizes needs."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_pack_rejects_what_cannot_fit(spark):
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame([(1, 2000)], "item long, size long"), 1000)


def test_plan_is_best_fit_item_by_item():
    rng = random.Random(15)
    for _ in range(60):
        capacity = rng.randint(5, 60)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 150))]
        counts = {s: sizes.count(s) for s in set(sizes)}
        runs, n = P.plan(counts, capacity)
        load = [0] * n
        for s, m in counts.items():
            mine = sorted((r[1:] for r in runs if r[0] == s))
            for rank in range(m):
                first, at, each = max(r for r in mine if r[0] <= rank)
                load[at + (rank - first) // each] += s
        assert sum(load) == sum(sizes) and max(load) <= capacity and min(load) > 0 and n == best_fit(sizes, capacity)


def test_pack_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_ROWS", 20)
    sizes = [7] * 90 + [0] * 30 + [30, 50, 99, 100] * 5
    df = spark.createDataFrame(list(enumerate(sizes)), "item long, size long").repartition(5)
    n = check(list(enumerate(sizes)), [(r.item, r.container) for r in P.pack(df, 100).collect()], 100)
    assert n == best_fit([s for s in sizes if s], 100)
    big = spark.createDataFrame([(i, 10**9 // 3) for i in range(9)], "item long, size long")
    assert check([(i, 10**9 // 3) for i in range(9)], [(r.item, r.container) for r in P.pack(big, 10**9 + 1).collect()], 10**9 + 1) <= 5


def test_pack_documents(spark):
    rng = random.Random(14)
    rows = [(i, "word " * rng.choice([0, 1, 5, 60, 300, 700, 3000]), None, None, None) for i in range(120)] + [(500, None, None, None, None), (None, "x", None, None, None)]
    got = P.pack_documents(spark.createDataFrame(rows, DOCS), 1024).collect()
    assert {r.doc_id for r in got} == set(range(120))
    load = {}
    for r in got:
        load[r.container] = load.get(r.container, 0) + r.n_tokens
    assert max(load.values()) <= 1024 and len(load) <= 1.05 * best_fit([r.n_tokens for r in got], 1024) + 1
    whole = {r[0] for r in rows if r[1] is not None and r[0] is not None and len(r[1].split()) <= 1000}
    assert all(sum(1 for x in got if x.doc_id == d) == 1 for d in whole)
