"""Alignment, ranked search and token counts against plain versions with the libraries themselves."""

import collections
import hashlib
import math
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tautline.llm import align, pretokens, search, tokens

D = "/root/testdata/sf0.001"
TEXTS = {
    1: "The quick brown fox.\nJumps over  the lazy dog", 2: "", 3: None, 4: "  two spaces  \n\n lines \t tab \n", 5: "<s>plain</s> <|endoftext|> <unk> <0x0A>", 6: "mark\u2581inside a text", 7: "é ß 東京 \u00a0 nbsp\u3000wide 🙂 क्षि",
    8: "a" * 6000 + " " + "b c " * 3000, 9: "The quick brown fox.\nJumps over  the lazy dog", 10: " ", 11: "\n", 12: "it's we'll 'tis\r\nline\u2028end \x00 \x1c \x85 x", 13: "price 12,345.67 $#@! -- ...", 14: "foo \n bar\n\n\nbaz   ",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", 1) for k, t in TEXTS.items()]
    return spark.createDataFrame([*rows, (None, "no name here", None, None), (1, TEXTS[1], "x", 1)], "doc_id long, text string, n_tokens string, pair int").cache()


@pytest.fixture(scope="module")
def models():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(align.byte_path())
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=pretokens.piece_path())


def plain_tokens(models, text):
    """Ids and ends of both models on the whole text, None if the bytes differ."""
    a, b = models
    t = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    by_a, by_b = align.token_bytes_a(open(align.byte_path(), "rb").read()), align.token_bytes_b(b)
    raw_a, raw_b = [by_a[i] for i in ids_a], [by_b[i] for i in ids_b]
    if not text or b"".join(raw_a) != t or b"".join(raw_b) != t:
        return None
    return ids_a, np.cumsum([len(x) for x in raw_a]).tolist(), ids_b, np.cumsum([len(x) for x in raw_b]).tolist()


def plain_align(models, texts):
    """texts by key; byte by byte."""
    got, held = {}, collections.Counter()
    for k, t in texts.items():
        x = plain_tokens(models, t or "")
        if x is None:
            continue
        ids_a, ends_a, ids_b, ends_b = x
        links = [(i, j) for i in range(len(ids_a)) for j in range(len(ids_b)) if max([0, *ends_a][i], [0, *ends_b][j]) < min(ends_a[i], ends_b[j])] if len(ids_a) < 500 else None
        if links is None:  # the same by the byte at which each token stands
            of_a, of_b = np.repeat(np.arange(len(ids_a)), np.diff(ends_a, prepend=0)), np.repeat(np.arange(len(ids_b)), np.diff(ends_b, prepend=0))
            links = sorted(set(zip(of_a.tolist(), of_b.tolist(), strict=True)))
        groups, p, q = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(f"{','.join(map(str, ids_a[p:i]))}|{','.join(map(str, ids_b[q:j]))}")
            p, q = i, j
        pairs = [(ids_a[i], ids_b[j]) for i, j in links]
        got[k] = len(ids_a), len(ids_b), groups, pairs
        held.update(set(pairs))
    best = collections.defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    none = (0, 0, 0, 0, 0, 0, "")
    return {
        k: (x[0], x[1], len(x[2]), len(x[3]), sum(held[p] == best[p[0]] for p in x[3]), sum(held[p] for p in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest()) if (x := got.get(k)) else none
        for k in texts
    }


def row_of(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256


@pytest.mark.parametrize("most", [align.PAIRS, 60])
def test_alignment(spark, docs, models, most):
    texts = {**TEXTS, None: "no name here", "again": TEXTS[1]}
    want = plain_align(models, texts)
    rows = align.align(docs, align.byte_path(), pretokens.piece_path(), most=most).collect()
    assert sorted(map(row_of, rows)) == sorted(want.values()) and all(row_of(r) == want[r.doc_id] for r in rows)
    assert want[6] == want[2] == want[3] == (0, 0, 0, 0, 0, 0, "") != want[10]
    assert align.align(docs.limit(0), align.byte_path(), pretokens.piece_path()).count() == 0


def test_alignment_query(spark, models):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    want = plain_align(models, texts)
    assert {r.doc_id: row_of(r) for r in align.op11_align(spark, D).collect()} == want


def test_slices():
    assert align.slices({3: 2, 1: 2, 2: 1, 9: 9, 10: 1}, 3) == [(1, 2), (3, 3), (9, 9), (10, 10)] and align.slices({}, 3) == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab T'sé\u2581\n\t \r\u00a0\u3000\x1c\x85.1<>東🙂", max_size=40))
def test_pretokens_encode_alone(text):
    a, b = LIBRARIES()
    if not text:
        return
    cut = pretokens.pretokens(text)
    assert "".join(cut) == " " + text
    assert [i for w in cut for i in a.encode(w, add_special_tokens=False).ids] == a.encode(" " + text, add_special_tokens=False).ids
    plain = text.replace("\u2581", " ")
    assert [i for ids in pretokens.encode_pretokens(b, pretokens.pretokens(plain)) for i in ids] == b.encode(text)


def LIBRARIES(kept=[]):  # noqa: B006, N802
    if not kept:
        from tokenizers import Tokenizer

        kept.append(Tokenizer.from_file(align.byte_path()))
        kept[0].encode_special_tokens = True
        kept.append(pretokens.load_pieces(pretokens.read_file(pretokens.piece_path())))
    return kept


def test_token_counts(spark, docs, models):
    want = {k: (len((t or "").encode()), len(models[1].encode(t or ""))) for k, t in {**TEXTS, None: "no name here"}.items()}
    for sample in (None, docs.limit(0)):
        rows = tokens.token_counts(docs, pretokens.piece_path(), sample).collect()
        assert len(rows) == docs.count() and all((r.n_bytes, r.n_tokens) == want[r.doc_id] for r in rows)
    assert tokens.token_counts(docs.limit(0), pretokens.piece_path()).count() == 0
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    got = {r.doc_id: r for r in tokens.op13_tokens(spark, D).collect()}
    assert {k: (r.n_bytes, r.n_tokens, r.over_limit) for k, r in got.items()} == {k: (len(t.encode()), n, n > 4096) for k, t in texts.items() for n in [len(models[1].encode(t))]}


def test_the_sample_comes_back_in_small_batches(docs, monkeypatch):
    whole = tokens.frequent_pretokens(docs)
    monkeypatch.setattr(tokens, "BATCH", 3)
    assert tokens.frequent_pretokens(docs) == whole and len(whole) > 20


def test_token_counts_without_room_for_a_cache(models, monkeypatch):
    counter = tokens.TokenCounter(pretokens.read_file(pretokens.piece_path()), {" The": 1})
    monkeypatch.setattr(tokens, "CACHED", 3)
    for k in (1, 8, 4, 1, 7):
        assert counter.counts([TEXTS[k]]) == [len(models[1].encode(TEXTS[k]))]


def test_token_counts_shuffle_nothing(docs):
    plan = tokens.token_counts(docs, pretokens.piece_path(), docs.limit(0))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(rows, items, k):
    """rows: (doc_id, text); each document scored by the formula."""
    cut = lambda t: TERM.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    docs = [(i, cut(t)) for i, t in rows]
    n_docs, n_terms = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    df = collections.Counter(t for _, w in docs for t in set(w))
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(cut(t))
    out = []
    for item, found in asked.items():
        scored = []
        for i, w in docs:
            tf = collections.Counter(w)
            m = 50 + 50 * len(w) * n_docs // n_terms if w else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in found if tf[t])
            if s > 0:
                scored.append((-s, float("-inf") if i is None else i, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2])[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize(("cells", "block", "k"), [(search.CELLS, search.ITEM_BYTES, 50), (700, 2000, 5), (1, 100, 1)])
def test_ranked_search(spark, monkeypatch, cells, block, k):
    monkeypatch.setattr(search, "CELLS", cells)
    rnd = np.random.default_rng(3)
    word = lambda n: " ".join(f"w{int(x)}" for x in rnd.zipf(1.3, n) % 300)
    rows = [(int(i), word(int(rnd.integers(0, 60)))) for i in rnd.permutation(180)]
    rows += [(1000 + i, rows[3][1]) for i in range(70)] + [(None, rows[3][1]), (5, rows[5][1]), (2000, None), (2001, ""), (2002, " .,! "), (2003, "É東京 WORD w1 " * 400), (2004, "x" * 9000)]
    items = [(i, word(12)) for i in range(25)] + [(30, rows[3][1]), (31, "É東京 word"), (32, None), (33, "nothing_known"), (None, "w1 w2"), (7, "w250 w251"), (34, "x" * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as n", "1 as rows", "2 as item").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'a' as rank")
    assert got(search.ranked_search(docs, asked, k, block=block)) == plain_search(rows, items, k)
    if k == 1:
        assert search.ranked_search(docs.limit(0), asked).count() == 0 and search.ranked_search(docs, asked.limit(0)).count() == 0


def test_ranked_search_query(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    sql = con.execute(search.ORACLE_SQL["op12_search"])
    assert [c[0] for c in sql.description] == ["item_id", "rank", "doc_id", "score"]
    want = sorted(sql.fetchall(), key=str)
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    assert got(search.op12_search(spark, D)) == want == plain_search(texts, items, 50)


def test_a_treap_gives_the_cells_it_was_built_from():
    rnd = np.random.default_rng(11)
    for n_rows, n_cols in ((1, 1), (3, 50), (60, 4), (33, 33)):
        at = np.unique(rnd.integers(0, n_rows * n_cols, 40))
        value = rnd.integers(1, 9, len(at))
        treap = search.Treap.build(at // n_cols, at % n_cols, value, n_rows, n_cols)
        ids = np.arange(n_cols) * 10
        for rows in (np.arange(n_rows), np.arange(0, n_rows, 2)):
            sums = collections.Counter()
            for r, c, v in zip((at // n_cols).tolist(), (at % n_cols).tolist(), value.tolist(), strict=True):
                sums[c] += v * (r in rows)
            for k in (1, 3, 1000):
                best = []
                treap.search(rows, ids, k, best)
                assert sorted(best, reverse=True) == sorted(((s, -10 * c) for c, s in sums.items() if s), reverse=True)[:k]
    assert Fraction(search.weight(10, 3), 1000) <= Fraction(math.log(22 / 7))
