"""The pipeline and the registry of this subpackage."""

import collections
import hashlib
import re
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import ROOT
from tests.llm.test_dedup import brute
from tests.llm.test_text_ops import slow_kept, slow_mix


def test_stages_and_run(spark, small):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality", "rules", "near_duplicates", "mixing", "encoding"]
    columns, counts = docs.columns, [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] > counts[3] > 0
    last = cp.STAGES[-1][1](spark, docs, small)
    key = lambda rows: sorted(map(tuple, rows))
    assert key(cp.run(spark, small).collect()) == key(last.collect())


def test_stages_match_plain_versions(spark, small):
    """Each stage's rows against loops over all of its input."""
    import sentencepiece

    import corpus_pipeline as cp
    from stridelake.llm import quality_rank as Q
    from stridelake.llm.queries import tokenizer_path

    stages = dict(cp.STAGES)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ids = lambda rows: sorted(r.doc_id for r in rows)
    table = lambda rows: spark.createDataFrame(rows, docs.schema)
    # strengths by hand; the weights have a test of their own
    ranker = Q.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    strength = lambda t: float(np.dot(Q.features((t or "").encode()), ranker.weights))
    rows = docs.collect()
    good = stages["quality"](spark, docs, small).collect()
    assert ids(good) == sorted(r.doc_id for r in rows if strength(r.text) >= ranker.threshold) and len(good) < len(rows)
    kept = stages["rules"](spark, table(good), small).collect()
    want = {r.doc_id for r, k in zip(good, slow_kept(good)[0]) if k}
    assert len(want ^ set(ids(kept))) <= 0.02 * len(good) and len(kept) < len(good)
    alone = stages["near_duplicates"](spark, table(kept), small).collect()
    assert ids(alone) == sorted(d for d, (_, c) in brute([(r.doc_id, r.text) for r in kept], 5).items() if c == d) and len(alone) < len(kept)
    mixed = stages["mixing"](spark, table(alone), small).collect()
    hashes = {r.doc_id: r.h for r in table(alone).select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    _, order = slow_mix([(r.doc_id, r.doc_id, r.source, size(r.text), hashes[r.doc_id]) for r in alone], 1 << 18)
    assert collections.Counter(ids(mixed)) == collections.Counter(row for _, row in order)
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    tokens = sorted((r.doc_id, len(i), sha(",".join(map(str, i))), sha(model.decode(i))) for r in mixed for i in [model.encode(r.text)])
    assert sorted(map(tuple, stages["encoding"](spark, table(mixed), small).collect())) == tokens


def test_stages_take_odd_rows(spark, small):
    import corpus_pipeline as cp

    rows = [(1, "a few plain words " * 30, "en", "s1", 1), (2, None, None, None, None), (3, "", "en", "s1", 0), (None, "no id at all " * 30, "en", None, 5), (1, "a few plain words " * 30, "en", "s1", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        assert stage(spark, df, small).count() >= 0 and stage(spark, df.where("false"), small).count() == 0


def test_registry():
    import __spark_entry__ as e

    names = list(e.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and "op6_url_filters" in e.oracle_sql()


def test_entry_works_without_the_subpackage(tmp_path):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.split('.')[:2] == ['stridelake', 'llm'] or name == 'corpus_pipeline': raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        f"sys.meta_path.insert(0, Gone()); sys.path.insert(0, {ROOT!r})\n"
        "import __spark_entry__ as e\n"
        "assert 'pipeline' not in e.queries() and 'temporal_stats' in e.queries() and not any(x.startswith('op') and x[2].isdigit() for x in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
