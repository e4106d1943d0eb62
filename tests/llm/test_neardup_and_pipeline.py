"""Near-duplicates against brute force, their pieces, and the pipeline."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_operators import SCHEMA, docs
from tidemark.llm import components, neardup

SF = "/root/testdata/sf0.001"


def brute(rows, width, percent=80):
    """component by document over all pairs: rows of (id, text)"""
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    top = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top[i], top[j]
                top = [y if t == x else t for t in top]
    least = {}
    for (d, _), t in zip(rows, top):
        least[t] = min(least.get(t, d), d)
    return {d: (len(s), least[t]) for (d, _), s, t in zip(rows, sets, top)}


def corpus(seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(12):
        base = list(rng.choice(words, 60))
        for _ in range(int(rng.integers(1, 25))):
            t = list(base)
            for _ in range(int(rng.integers(0, 9))):
                t[int(rng.integers(len(t)))] = str(rng.choice(words))
            out.append(" ".join(t))
    return [out[i] for i in rng.permutation(len(out))] + [None, "", "  ", "one", "ONE", "two words", "two  Words"]


def test_against_brute_force_with_small_and_large_nodes_and_classes(spark):
    texts = corpus()
    df = docs(spark, texts).withColumns({"n": F.lit("clash"), "rep": F.lit(1), "kept": F.lit(2)})
    want = brute(list(enumerate(texts)), 2)
    for settings in ({}, {"node_limit": 5, "class_limit": 4}, {"node_limit": 3, "class_limit": 2, "depth": 2}):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, width=2, **settings).collect()}
        assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}


def pages(n, body=250, own=45, copies=0, vocabulary=0):
    """n pages of one template, at a similarity of about 0.7, and copies of every tenth with another word. A page's words are its own, or
    from a vocabulary of that many with frequencies by Zipf's law."""
    rng = np.random.default_rng(11)
    shares = 1 / np.arange(1, vocabulary + 1)
    out = []
    for k in range(n):
        words = [f"v{i}" for i in rng.choice(vocabulary, own, p=shares / shares.sum())] if vocabulary else [f"own{k}x{i}" for i in range(own)]
        t = [f"t{i}" for i in range(body)] + words
        out += [" ".join(t)] + [" ".join([*t[:-1], f"c{c}"]) for c in range(copies if k % 10 == 0 else 0)]
    return out


@pytest.mark.parametrize("paired", [neardup.PAIRED, 2])
def test_classes_are_cut_finer_without_losing_links(spark, monkeypatch, paired):
    for name, value in {"PIVOTS": 2, "CHUNK": 16, "PART": 4, "FINER": 3, "PAIRED": paired}.items():
        monkeypatch.setattr(neardup, name, value)
    # 0.72 shared with the template, copies, pages that hardly differ, and pages whose words come from few
    texts = corpus(7) + pages(60, 60, 12, copies=2) + pages(30, 20, 1) + pages(60, 60, 12, copies=2, vocabulary=40)
    want = brute(list(enumerate(texts)), 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, texts), width=2, class_limit=4).collect()}
    assert got == want


@pytest.mark.parametrize("vocabulary", [0, 20_000])
def test_template_pages_do_not_meet_each_other(spark, monkeypatch, vocabulary):
    sent, whole = [], neardup._against_pivots

    def counted(rows, *more):
        sent.append(rows.count())
        return whole(rows, *more)

    monkeypatch.setattr(neardup, "_against_pivots", counted)
    monkeypatch.setattr(neardup, "FINER", 100)
    totals = []
    for n in (400, 800):
        sent.clear()
        assert all(r.kept for r in neardup.near_duplicates(docs(spark, pages(n, vocabulary=vocabulary)), width=2).collect())
        totals.append(sum(sent))
    assert 0 < totals[1] <= 2.1 * totals[0]


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(4, "a b c d", None, None, None), (4, "a b c d", None, None, None), (2, "a b c d", None, None, None), (None, "a b c d", None, None, None), (9, "x", None, None, None), (9, "y z", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(2, 2, True), (4, 2, False), (4, 2, False), (9, 9, True), (9, 9, True), (None, None, True)], key=repr)
    left = neardup.without_near_duplicates(df).collect()
    assert sorted((r.doc_id or -1, r.text) for r in left) == [(-1, "a b c d"), (2, "a b c d"), (9, "x"), (9, "y z")]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("one_task", [components.ONE_TASK, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(100)] + [(9, 9)]
    nodes = sorted({x for e in edges for x in e})
    place = {x: i for i, x in enumerate(nodes)}
    label = components.smallest(np.array([place[a] for a, _ in edges]), np.array([place[b] for _, b in edges]), len(nodes))
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: nodes[label[place[x]]] for x in nodes}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_makes_its_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 4), (3, 3)], "a long, b long").mapInArrow(run, "a long, b long")
    assert sorted(tuple(r) for r in components.components(edges).collect()) == [(1, 1), (2, 1), (3, 1), (4, 4)]
    assert made.value == 4


def test_steps_over_few_sets_do_not_run_a_task_for_each_shuffle_partition(spark, monkeypatch):
    for name, value in {"FINER": 3, "PIVOTS": 2}.items():
        monkeypatch.setattr(neardup, name, value)
    sc, held = spark.sparkContext, {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    texts = pages(60, 60, 12, copies=2)
    sc.setJobGroup("few-sets", "near-duplicates of few sets")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, texts), width=2, node_limit=20, class_limit=4).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == brute(list(enumerate(texts)), 2)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few-sets") for s in tracker.getJobInfo(j).stageIds}
    assert sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i) < 2500


def test_postings_find_all_links():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.choice(50, int(rng.integers(1, 40)))).astype(np.uint64) for _ in range(60)]
    index = neardup.Postings(sets[:20])
    found = {(int(i), int(j)) for a, b in index.linked(sets, 50, most=200) for i, j in zip(a, b)}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:20]) if 100 * len(np.intersect1d(a, b)) >= 50 * len(np.union1d(a, b))}
    assert found == want and all(neardup.linked(sets[i], sets[j], 50) for i, j in want)


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    df, columns, kept = spark.read.parquet(f"{SF}/documents.parquet"), None, []
    for name, stage in cp.STAGES:
        before = df
        df = cp.stored(stage(spark, df, SF), name)
        columns = columns or before.columns
        if name != cp.STAGES[-1][0]:
            assert df.columns == columns
        kept.append({r.doc_id for r in df.select("doc_id").collect()})
    clean = [d for d, t in labels.items() if not t]
    assert sum(d in kept[0] for d in clean) >= 0.95 * len(clean) and len(kept[0]) < len(texts)
    assert kept[1] == kept[0] and kept[3] == kept[2] == kept[4]
    # near copies by brute force over the texts that this stage gets (no line goes in the previous one here)
    want = brute(sorted((d, texts[d]) for d in kept[1]), 5)
    assert kept[2] == {d for d, (_, c) in want.items() if c == d}
    by_seq = {}
    for r in df.collect():
        by_seq.setdefault(r.sequence_id, []).append(r.length)
    assert max(map(sum, by_seq.values())) <= 4096


def test_pipeline_over_odd_rows(spark, tmp_path):
    import corpus_pipeline as cp

    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", None, "s", 0), (3, "bob@x.org " * 3, None, "s", 5), (3, "bob@x.org " * 3, None, "s", 5), (4, "y" * 300_000, None, None, None)], SCHEMA)
    for k, df in enumerate((odd, odd.limit(0))):
        path = tmp_path / str(k)
        df.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        rows = cp.run(spark, str(path)).collect()
        assert sorted({r.doc_id or -1 for r in rows}) == ([-1, 1, 2, 3, 4] if k == 0 else [])
