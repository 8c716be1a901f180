"""The operators' registered queries agree with their DuckDB SQL on sf0.001, and the pipeline with brute force."""

import os

import duckdb
import pytest

import corpus_pipeline
from retentio.llm import bpe, line_dedup, near_dedup
from retentio.llm.oracles import ORACLES
from retentio.llm.queries import QUERIES
from scripts.check_oracle import TABLES, rows_of


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_small}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_small, con, key):
    sdf = QUERIES[key](spark, sf_small)
    cur = con.execute(ORACLES[key])
    cols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(cols)
    assert rows_of(sdf.columns, [tuple(r) for r in sdf.collect()]) == rows_of(cols, cur.fetchall())


def planted(spark, docs):
    """The documents and, with larger ids, exact copies, copies with an edited word in one line, and near copies without common lines."""
    text = {r.doc_id: r.text for r in docs.collect() if r.text and len(r.text.split()) > 60}
    some = sorted(text)[:30]
    copies = [(10_000 + i, text[i]) for i in some[:10]]
    edited = [(20_000 + i, text[i].replace(text[i].split()[20], "edited", 1)) for i in some[10:20]]
    # All words on one line each time: line dedup finds nothing, near-duplicate search does.
    near = [(30_000 + i, " ".join(text[i].split()) + " end") for i in some[20:]] + [(40_000 + i, " ".join(text[i].split()) + " stop") for i in some[20:]]
    rows = [(i, t, "en", "planted", len(t)) for i, t in copies + edited + near]
    return docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(docs.columns))


def test_pipeline_stages(spark, sf_small):
    """Each stage on its own input: what it drops is what its operator says, and all columns stay."""
    docs = planted(spark, spark.read.parquet(f"{sf_small}/documents.parquet"))
    columns, left = docs.columns, {}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "near-duplicates", "decontamination", "byte-level BPE"]
    for name, stage in list(stages.items())[:-1]:
        before = docs
        docs = corpus_pipeline.saved(stage(spark, docs, sf_small))
        assert docs.columns == columns
        left[name] = {r.doc_id for r in docs.collect()}
        if name == "line dedup":
            want = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(before).where("n_dropped = 0").collect()}
            cut = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(before).where("n_dropped > 0").collect()}
            want |= {i: t for i, t in cut.items() if any(len(x.strip(" \t\n\x0b\x0c\r")) >= line_dedup.MIN_CHARS for x in t.split("\n"))}
            assert {r.doc_id: r.text or "" for r in docs.collect()} == want
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "near-duplicates":
            told = near_dedup.near_duplicates(before).collect()
            assert left[name] == {r.doc_id for r in told if r.kept or r.n_shingles == 0}
    assert len(left["toxicity"]) < spark.read.parquet(f"{sf_small}/documents.parquet").count() + 40
    # Exact copies are gone after line dedup, near copies without common lines after the near-duplicate stage.
    assert not any(10_000 <= i < 20_000 for i in left["line dedup"])
    assert sum(i >= 30_000 for i in left["line dedup"]) >= 16 and sum(i >= 30_000 for i in left["near-duplicates"]) <= sum(i >= 30_000 for i in left["line dedup"]) / 2
    assert left["line dedup"] > left["near-duplicates"] >= left["decontamination"]
    coded = {r.doc_id: r for r in stages["byte-level BPE"](spark, docs, sf_small).collect()}
    ranks = bpe.parse_ranks(open(corpus_pipeline.public_tokenizers.path(corpus_pipeline.RANKS), "rb").read())
    import tiktoken
    public = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {i: list(r.ids) for i, r in coded.items()} == {r.doc_id: public.encode_ordinary(r.text or "") for r in docs.collect()}


@pytest.mark.parametrize("which", ["odd_docs", "no_docs"])
def test_pipeline_on_odd_and_empty_tables(which, request, spark, sf_small):
    docs = request.getfixturevalue(which)
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, sf_small))
        assert docs.columns == request.getfixturevalue(which).columns and docs.count() <= n
        n = docs.count()
        if which == "odd_docs":
            assert {3, 4, 5} <= {r.doc_id for r in docs.collect()}  # null, empty and blank texts are no copies of each other
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_small).count() == n
