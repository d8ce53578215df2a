"""The corpus pipeline against plain steps, stage by stage."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as P
from logtide.llm import mixing, quality, secrets
from logtide.llm.queries import vocabulary


def _first_of_groups(docs):
    """Smallest id of each group of texts linked by a Jaccard likeness of 0.8 of five-word sets, pair by pair."""
    sets = []
    for _, t in docs:
        w = (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = [i for i, _ in docs]
    changed = True
    while changed:
        changed = False
        for i in range(len(docs)):
            for j in range(i):
                if up[i] != up[j] and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0):
                    up[i] = up[j] = min(up[i], up[j])
                    changed = True
    return sorted(set(up))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "near_copies", "secrets", "mixing", "packing"] and P.ORACLE_SQL is None
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns
        rows = out.collect()
        before = docs.collect()
        if name == "quality":
            good = {r.row.doc_id for r in quality.classify_quality(docs).collect() if r.quality_good}
            assert {r.doc_id for r in rows} == good and 0 < len(rows) < len(before)
        elif name == "near_copies":
            firsts = _first_of_groups([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in rows) == firsts and len(firsts) < len(before)
        elif name == "secrets":
            was = {r.doc_id: r.text for r in before}
            assert all(r.text == secrets.redact(was[r.doc_id], secrets.secret_spans(was[r.doc_id], vocabulary("word_bpe_49k.json"))) and r.n_chars == len(r.text) for r in rows) and len(rows) == len(was)
        elif name == "mixing":
            copies = {r.row.doc_id: r.mix_copies for r in mixing.mix_sources(docs).collect()}
            assert Counter(r.doc_id for r in rows) == Counter({i: n for i, n in copies.items() if n})
        else:
            assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in before)
        docs = spark.createDataFrame(rows, docs.schema) if name != "packing" else docs


def test_odd_rows(spark):
    rows = [(None, "Some plain words stand here.", "en", "a", 1), (None, None, None, None, None), (1, "", "en", "a", 0), (2, "Words of a plain text stand here too.", "en", None, 5), (2, "Words of a plain text stand here too.", "en", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, "").count() <= 2 * len(rows) * 3
        assert stage(spark, docs.limit(0), "").count() == 0
    assert P.drop_near_copies(spark, docs, "").where("doc_id = 2").count() == 1
    assert P.STAGES[-1][1](spark, docs, "").count() == len(rows)
