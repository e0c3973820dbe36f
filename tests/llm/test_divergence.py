"""The divergence audit against a plain version in Python integers."""

import re
from collections import Counter, defaultdict

import pytest

from pulsegrid.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows, least=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, own, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        words = [w.translate(LOWER) for w in TERM.findall(text)]
        groups[lang].add(source)
        docs[lang].update(set(words))
        own[lang, source].update(words)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        share = lambda counts: {t: 1 + (10 ** 9 * (counts[t] + 2)) // (sum(counts[x] for x in kept) + 2 * len(kept)) for t in kept}
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        whole = Counter()
        for s in sources:
            whole += own[lang, s]
        q, p = share(whole), {s: share(own[lang, s]) for s in sources}
        for s in sources:
            far = sorted(((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources - {s}))
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(far)}
            terms = sorted((-gap(p[s][t], q[t]), t.encode(), t) for t in kept if own[lang, s][t] > 0 and p[s][t] > q[t])
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms[:top])}
    return out


def check(spark, rows, **options):
    frame = spark.createDataFrame([(i, *r, "clash", 7) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n int")
    got = [tuple(r) for r in divergence.audit(frame, **options).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, **{"least": options.get("least_docs", 10), "top": options.get("top", 10)})
    return got


def test_small_tables(spark):
    rows = [("en", f"s{i % 4}", f"The {'café' if i % 3 else 'CAFÉ'} word{i % 5} of-the x{i}") for i in range(60)]
    rows += [("de", "s1", "ein Wort"), ("de", "s2", None), (None, None, None), ("", "s9", "a b"), ("en", "void", ""), ("en", None, "the the the")]
    check(spark, rows)
    check(spark, rows + rows[:20], least_docs=2, top=3)


def test_ties_are_expanded_in_utf8_order(spark):
    words = ["zeta", "éa", "alpha", "ßx", "Ω", "𝒳", "￦y", "Beta"]
    rows = [("en", "a", " ".join(words))] * 5 + [("en", "b", "other")] * 5 + [("en", "c", None)]
    got = check(spark, rows, least_docs=1, top=6)
    terms = [r[3] for r in sorted(got, key=lambda r: r[5]) if r[1] == "a" and r[2] == "term"]
    assert terms == sorted([w.translate(LOWER) for w in words], key=str.encode)[:6]


def test_without_kept_terms_and_without_rows(spark):
    got = check(spark, [("en", "a", "once"), ("en", "b", None), ("en", "B", "1 2 3")])
    assert {r[4] for r in got} == {0} and len(got) == 6
    empty = divergence.audit(spark.createDataFrame([], "doc_id long, lang string, source string, text string"))
    assert empty.count() == 0


def test_long_texts_and_many_sources(spark):
    rows = [("en", f"s{i % 40}", f"common w{i % 7} w{i % 11}") for i in range(400)] + [("en", "s3", "common Long " * 60000)] * 2
    check(spark, rows)


@pytest.mark.parametrize("size", [60, 1 << 20])
def test_slices_do_not_matter(spark, monkeypatch, size):
    import pyarrow as pa

    rows = [(f"l{i % 2}", f"s{i % 3}", f"one two{i % 4} Two{i % 4}") for i in range(50)]
    monkeypatch.setattr(divergence, "slices", lambda b, c: _cut(b, size))
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["lang", "source", "text"])
    total = Counter()
    for out in divergence._count(iter([batch])):
        for r in out.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["n"]
    want = Counter((a, b, w.translate(LOWER)) for a, b, t in rows for w in TERM.findall(t))
    assert total == want


def _cut(batch, size):
    step = max(1, size // 20)
    return [batch.slice(i, step) for i in range(0, batch.num_rows, step)]
