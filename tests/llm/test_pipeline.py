"""Each stage of the pipeline against a plain version, on the smallest tables."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
import tiktoken

import corpus_pipeline as pipeline
from spindrift.llm import bpe, decontaminate, simhash, toxicity
from spindrift.llm.queries import OP9_SQL, ranks_path, table
from spindrift.llm.shared import tables_written
from tests.llm.test_operators import plain_lines

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of each stage."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), table(spark, DATA, "documents"), []
    for name, stage in pipeline.STAGES:
        done = stage(spark, docs, DATA)
        done.write.parquet(str(folder / name))
        after = spark.read.parquet(str(folder / name))
        out.append((docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return out


def test_columns(stages):
    assert len(pipeline.STAGES) == 5
    for before, after, own, new in stages[:-1]:
        assert own == new and 0 < len(after) <= len(before)


def test_toxicity_stage(spark, stages):
    before, after, *_ = stages[0]
    docs = table(spark, DATA, "documents")
    model = toxicity.fit(docs, table(spark, DATA, "labels"))
    scored = {r.doc_id: r.predicted for r in toxicity.score_texts(docs, model).collect()}
    assert {r.doc_id for r in after} == {i for i, p in scored.items() if not p}


def test_line_stage(stages):
    before, after, *_ = stages[1]
    want = plain_lines([(r.doc_id, r.text) for r in before])
    assert {r.doc_id: r.text for r in after} == {i: t for i, (_, _, t) in want.items()}
    assert all(r.n_chars == len(r.text) for r in after)


def similar_components(texts, least=0.8, k=5):
    """Smallest id of each group that links of similarity over distinct shingles connect, all pairs compared."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or {tuple(w)}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, alike = sorted(sets), 0
    for at, a in enumerate(ids):
        for b in ids[:at]:
            shared = len(sets[a] & sets[b])
            if shared >= least * (len(sets[a]) + len(sets[b]) - shared):
                root[max(find(a), find(b))] = min(find(a), find(b))
                alike += 1
    return {i: find(i) for i in ids}


def test_near_duplicate_stage(stages):
    """What goes has a similar text that stays; nothing else goes; at least nine tenths of what all pairs find."""
    before, after, *_ = stages[2]
    groups = similar_components({r.doc_id: r.text for r in before})
    kept = {r.doc_id for r in after}
    gone = set(groups) - kept
    assert gone <= {i for i, low in groups.items() if i != low} and set(groups.values()) <= kept
    assert len(gone) >= 0.9 * sum(i != low for i, low in groups.items()) > 0


def test_similar_texts_are_found(spark):
    """Copies of every share of changed words: found if similar, kept if not; copies and short texts."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    texts = {}
    for i in range(150):
        w = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        share = rng.choice([0.0, 0.004, 0.008, 0.016, 0.05])
        texts[2 * i], texts[2 * i + 1] = " ".join(w), "  ".join(rng.choice(words) if rng.random() < share else x.upper() for x in w)
    texts |= {1_000: "one two", 1_001: "ONE\ntwo", 1_002: "one two three", 1_003: "", 1_004: None, 1_005: "one two three four five", 1_006: "one two three four six"}
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id int, text string, node string, f0 int").repartition(3)
    kept = {r.doc_id for r in simhash.first_of_similar(df).collect()}
    groups = similar_components(texts)
    expected = {i for i, low in groups.items() if i != low}
    assert set(texts) - kept <= expected and len(set(texts) - kept) >= 0.95 * len(expected)
    assert {1_001, 1_004}.isdisjoint(kept) and {1_000, 1_002, 1_003, 1_005, 1_006} <= kept
    assert simhash.first_of_similar(df).columns == df.columns and simhash.first_of_similar(df.where("false")).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, None), (7, "a b"), (7, "a b"), (8, "")], "doc_id int, text string")
    assert sorted(((r.doc_id or 0), r.text) for r in simhash.first_of_similar(odd).collect()) == [(7, "a b"), (8, "")]


def test_run_leaves_no_tables_behind(spark):
    before = set(tables_written(spark))
    rows = pipeline.run(spark, DATA).count()
    left = [x for x in tables_written(spark) if x not in before]
    assert rows > 0 and len(left) == 1  # what the last stage reads


def test_decontamination_stage(spark, stages):
    before, after, *_ = stages[3]

    def clean(t):
        marks = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
        return [w for w in (x.strip(marks) for x in (t or "").encode().lower().split()) if w]

    items = [clean(r.text) for r in table(spark, DATA, "benchmark").collect()]
    leaky = set()
    for r in before:
        ws = clean(r.text)
        for item in items:
            if len(set(item) & set(ws)) < decontaminate.COVERAGE * len(set(item)):
                continue
            if sum(n for *_, n in decontaminate.tile(item, ws)) >= decontaminate.COVERAGE * len(item):
                leaky.add(r.doc_id)
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == leaky


def test_token_stage(stages):
    import public_tokenizers

    before, after, *_ = stages[4]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.coder(ranks_path()).ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert list(r.ids) == ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()


def test_run_gives_the_last_stage(spark, stages):
    assert {r.doc_id: r.ids_sha256 for r in pipeline.run(spark, DATA).select("doc_id", "ids_sha256").collect()} == {r.doc_id: r.ids_sha256 for r in stages[-1][1]}


def test_sql_of_line_dedup_is_registered():
    from spindrift.llm.queries import ORACLES

    assert ORACLES["op9_line_dedup"] == OP9_SQL


def test_no_member_of_a_large_group_is_spared(spark):
    """All pairs are found: links that only one member of a large group has, cells cut in chunks, any order of shingles."""
    import random

    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(90):  # a large group
        words = list(base)
        words[rng.randrange(60)] = f"x{i}"
        texts[i] = " ".join(words)
    for i in range(90, 180):  # chains that leave it from one member each
        words = texts[i - 90].split()
        words[rng.randrange(60)] = f"y{i}"
        texts[i] = " ".join(words)
    for i in range(180, 300):  # a common passage in texts of their own
        texts[i] = " ".join([f"z{i}_{j}" for j in range(rng.randint(10, 30))] + base[:15])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = similar_components(texts)
    plain = df.toDF("c0", "c1")
    for size in (7, 4_096):
        got = {}
        for r in simhash.similar_groups(plain, "c0", "c1", cell_size=size).join(simhash._with_node(plain, 1), "node").collect():
            got[r.c0] = r.low
        assert got == want


def test_marks_rule_out_unlike_sets_of_any_size():
    """No similar pair is ruled out; unlike ones are, however large, and so are those of unlike sizes."""
    import pyarrow as pa

    rng = np.random.default_rng(7)

    def left(pairs):
        columns = [list(range(len(pairs))), [-i for i in range(len(pairs))], [simhash._marks(x) for x, _ in pairs], [simhash._marks(y) for _, y in pairs]]
        batch = pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), *[pa.array(c, pa.binary()) for c in columns[2:]]], names=["a", "b", "ma", "mb"])
        return {i for out in simhash._may_by_marks(iter([batch]), 0.8) for i in out.column("a").to_pylist()}

    some = lambda n: np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    alike, unlike = [], []
    for n in (1, 5, 64, 70, 1_000, 1_030, 4_100, 20_000, 70_000):
        base = some(n)
        alike += [(base, base), (base, base[: -(-len(base) * 4 // 5)]), (np.unique(np.concatenate([base, some(n // 4)])), base)]
        cut = len(base) // 18  # of each side its own: 17 of 19 shared
        alike.append((np.concatenate([base[cut:], some(cut)]), base))
        if n >= 64:
            unlike += [(base, some(n)), (base, some(n * 9 // 10)), (base, base[: len(base) // 2]), (np.concatenate([base[: n // 2], some(n - n // 2)]), base)]
    alike = [(x, y) for x, y in alike if len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))]
    assert len(alike) >= 30 and left(alike) == set(range(len(alike)))
    assert not left(unlike)


def test_sets_move_only_for_pairs_that_may_be_similar(spark, monkeypatch):
    """Large unlike texts with common passages: their candidates end at the marks, so that no set is sent."""
    rng = random.Random(5)
    shared = [[f"s{i}_{j}" for j in range(5)] for i in range(40)]
    texts = []
    for i in range(30):
        words = [f"w{i}_{j}" for j in range(5_000)]
        for passage in shared:
            at = rng.randrange(len(words))
            words[at:at] = passage
        texts.append((i, " ".join(words)))
    texts.append((30, texts[0][1] + " and more"))
    sent, plain = [], simhash.written

    def counted(df, *a, **b):
        out = plain(df, *a, **b)
        if dict(out.dtypes).get("x") == "array<bigint>":
            sent.append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", counted)
    kept = {r.doc_id for r in simhash.first_of_similar(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}
    assert kept == set(range(30))
    assert sent and sum(sent) <= 4, sent


def test_one_python_step_a_stage(spark, monkeypatch):
    """Spark keeps a worker process for each step in Python of a stage; the rows that stay are not read into Python at all."""
    most, plain = [], simhash.written

    def steps(node):
        """Steps in Python between two exchanges, and how many the last one has so far."""
        kids = [steps(node.children().apply(i)) for i in range(node.children().size())]
        done, now = max([0, *(x for x, _ in kids)]), max([0, *(x for _, x in kids)])
        now = 0 if "Exchange" in node.nodeName() else now + ("InArrow" in node.nodeName())
        return max(done, now), now

    def seen(df, *a, **b):
        most.append(steps(df._jdf.queryExecution().sparkPlan())[0])
        return plain(df, *a, **b)

    monkeypatch.setattr(simhash, "written", seen)
    base = [f"w{j}" for j in range(80)]
    rows = [(i, " ".join([*base[:40], f"x{i}", *base[40:]])) for i in range(20)] + [(100 + i, "one and the same") for i in range(5)]
    out = simhash.first_of_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert max(most) == 1, most
    assert steps(out._jdf.queryExecution().sparkPlan())[0] == 0
    assert {r.doc_id for r in out.collect()} == {0, 100}


def test_repeated_ids_stay_in_part(spark):
    """Ids with several texts, of which some go; rows repeated as they are; null ids."""
    rng = random.Random(3)
    texts = ["a b", "A  b", "c", "C", "", None, "d e f", "g", "h", "i j"]
    rows = [(rng.choice([None, *range(12)]), rng.choice(texts)) for _ in range(60)]
    rows += [(20, "only here"), (21, "twice"), (21, "twice"), (None, "of no id"), (None, "of no id")]
    want: dict = {}
    for i, t in rows:
        words = tuple((t or "").lower().split())
        want[words] = min(want.get(words, (True, 0)), (i is None, i or 0))
    got = [((r.doc_id is None, r.doc_id or 0), tuple((r.text or "").lower().split())) for r in simhash.first_of_similar(spark.createDataFrame(rows, "doc_id int, text string").repartition(4)).collect()]
    assert sorted(got) == sorted((i, w) for w, i in want.items())


def test_texts_are_encoded_in_small_chunks(spark, monkeypatch):
    """Workers stay, and keep the room that a chunk took; the ids do not depend on the chunks."""
    texts = [(i, " ".join(f"word{i * j % 977}" for j in range(4_000))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    sizes, plain, made = [], bpe.Coder.encode, bpe.coder(ranks_path())
    want = {i: made.encode(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0].tolist() for i, t in texts}
    monkeypatch.setattr(bpe.Coder, "encode", lambda self, data, offsets: (sizes.append(len(data)), plain(self, data, offsets))[1])
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: [x for b in self.toArrow().to_batches(max_chunksize=100) for x in f(iter([b]))])
    got = {i: list(ids) for b in bpe.encode_texts(df, ranks_path()) for i, ids in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True)}
    assert got == want and len(sizes) > 1 and max(sizes) <= 1 << 19
