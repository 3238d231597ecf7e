"""The pipeline end to end against plain Python: quality by SQL, near copies by all pairs, redaction, mixing, the tokenizer library."""

import hashlib
import random
import weakref

import corpus_pipeline
import duckdb
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from tessella.llm import bpe_automaton, mixing, queries, quality, secret_scan, shingles, simhash
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def good_ids(rows):
    """Places of the rows that the rules keep, by the SQL for the rules."""
    con = duckdb.connect()
    con.register("given", pd.DataFrame({"doc_id": range(len(rows)), "text": pd.Series([r["text"] for r in rows], dtype=object)}))
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text FROM given")
    sql = quality.verdicts_sql()
    return {i for (i,) in con.execute(f"SELECT doc_id FROM ({sql}) WHERE kept").fetchall()}


def without_near_copies(rows, similarity=0.8):
    """One row of each group linked by similarity: all pairs that share a shingle are compared."""
    sets = [frozenset(shingles.shingle_hashes(r["text"], 5).tolist()) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for h in s:
            by.setdefault(h, []).append(i)
    for i, j in {(i, j) for found in by.values() for i in found for j in found if i < j}:
        if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i) if sets[i] else ("none", i), []).append(i)
    first = lambda i: (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0)
    return groups, {k: min(map(first, g)) for k, g in groups.items()}


def digests(text, library):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def expected(spark, rows, schema):
    kept = good_ids(rows)
    rows = [r for i, r in enumerate(rows) if i in kept]
    groups, first = without_near_copies(rows)
    stay = []
    for k, members in groups.items():
        # of rows with one id any may stand for the group; here they agree in text
        stay.append(min((rows[i] for i in members if (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0) == first[k]), key=lambda r: r["text"] or ""))
    clean = [{**r, "text": None if r["text"] is None else secret_scan.redact_text(r["text"], "[secret]")} for r in stay]
    copies = mixing.mix(spark.createDataFrame([tuple(r[f] for f in schema.names) for r in clean], schema)).collect() if clean else []
    library = Tokenizer.from_file(public_tokenizers.path(queries.WORD_TOKENIZER))
    by = {}
    for r in clean:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(len(b) == 1 for b in by.values())
    return sorted(repr((x.doc_id, *digests(by[x.doc_id][0]["text"], library))) for x in copies for _ in range(x.copies))


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def found(df):
    return sorted(repr((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in df.collect())


def test_pipeline_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = found(corpus_pipeline.run(spark, SF))
    assert len(got) > 50 and got == expected(spark, rows_of(docs), docs.schema)


@pytest.fixture
def odd_dir(spark, tmp_path):
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeiourstln") for _ in range(r.randrange(2, 9)))
    prose = lambda n: " ".join(r.choice(["the", "of", "and", "to", "in", word(), word(), word()]) for _ in range(n)) + "."
    long = prose(20_000)
    base = [prose(r.randrange(40, 200)) for _ in range(40)]
    near = []
    for t in base[:12]:
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    texts = [None, "", " \n\t", long, "one", *base, *near, *base[:5], "x" * 5000, prose(60) + " password: Zx9hunter2Qp and on " + prose(50), "é " * 50, "日本語 テスト " * 30]
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"src{i % 3}", None if t is None else len(t), True, i, "k") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, prose(70), None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, copies int, `__key` string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_pipeline_on_odd_rows(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    got = found(corpus_pipeline.run(spark, odd_dir))
    assert got == expected(spark, rows_of(docs), docs.schema)
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, odd_dir)
        assert now.schema.names == docs.schema.names and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema]


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_of_the_table_equal_all_pairs(spark):
    """Links between documents of sf0.01, after the quality rules: none is lost."""
    docs = quality.keep_good(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    _, first = without_near_copies(rows_of(docs))
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == {k[1] for k in first.values()}


def test_encoding_leaves_no_chunks_in_the_worker(spark, monkeypatch):
    """Spark reuses a Python worker for the next stage; what the last task remembered must not stay in it."""
    works, real = [], bpe_automaton.map_texts

    def seen(docs, columns, work, schema):
        works.append(work)
        return real(docs, columns, work, schema)

    monkeypatch.setattr(bpe_automaton, "map_texts", seen)
    corpus_pipeline.encode(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    path = public_tokenizers.path(queries.WORD_TOKENIZER)
    texts = ["The quick brown fox", None, "jumps over the lazy dog"]
    out = works[0](iter([pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], ["id", "text"])]))
    got = next(out).to_pylist()
    library = Tokenizer.from_file(path)
    assert [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got] == [digests(t, library) for t in texts]
    chunks = weakref.ref(bpe_automaton._digest_memos(bpe_automaton.tokenizer_bytes(path))[0])
    assert len(chunks()) == 9 - 1  # "the" comes twice
    assert next(out, None) is None
    assert chunks() is None and bpe_automaton._digest_memos.cache_info().currsize == 0
