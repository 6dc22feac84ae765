import base64
import collections
import gzip
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from petrichor.llm import sequences, warc
from petrichor.llm.files import open_at

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def pages(spark):
    big = "é" * 100_000
    rows = [(1, "http://a/ b", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "u", big), (6, "u", big), (7, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "u", "<p>one</p>"), (8, "u", "x"), (8, "u", "x")]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"sha1": F.lit(1), "chunk": F.lit(2)})


@pytest.mark.parametrize("chunk_bytes", [7, 64 * 1024])
def test_warc_round_trip(spark, chunk_bytes):
    rows, df = pages(spark)
    files = warc.archive(df, chunk_bytes=chunk_bytes)
    chunks = warc.read_chunks(files, chunk_bytes=chunk_bytes)
    got = warc.records_of(chunks).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = max(first.get(h or "", i), i)
    want = collections.Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        again = i != first[h or ""]
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None] += 1
    assert collections.Counter((r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert chunks.agg(F.max(F.length("chunk"))).first()[0] <= chunk_bytes
    assert {r["url"] for r in got} == {"http://a/%20b", "http://a/2", "u", None}
    small = warc.archive(df, min_bytes=5)  # payloads under the bound are all responses
    kinds = {(r["record_id"], r["record_type"]) for r in warc.records_of(warc.read_chunks(small)).collect()}
    assert {(8, "response"), (3, "response"), (4, "response"), (1, "revisit"), (2, "response")} <= kinds and (8, "revisit") not in kinds
    assert warc.read_chunks(warc.archive(df.limit(0))).count() == 0


def test_warc_files_are_plain_warc(spark):
    _, df = pages(spark)
    text = b""
    for r in warc.archive(df.filter("page_id = 1")).collect():
        system, path = open_at(r["file"])
        text += gzip.decompress(system.open_input_stream(path, compression=None).read())
    head, http, body = text.split(b"\r\n\r\n", 2)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>") and http.startswith(b"HTTP/1.1 200") and body == b"<p>one</p>\r\n\r\n"


def test_damaged_archive_is_noticed(spark, tmp_path):
    _, df = pages(spark)
    files = warc.archive(df.filter("page_id = 1"))
    system, path = open_at(files.first()["file"])
    data = gzip.decompress(system.open_input_stream(path, compression=None).read()).replace(b"<p>one", b"<p>two")
    (tmp_path / "bad.warc.gz").write_bytes(gzip.compress(data))
    bad = spark.createDataFrame([(str(tmp_path / "bad.warc.gz"), 1)], "file string, records bigint")
    with pytest.raises(Exception, match="damaged record"):
        warc.records_of(warc.read_chunks(bad)).collect()


TRICKY = ["foo  bar\n baz's  x's y 'tis  3 4a\t b", " a", "  ", "a \x00 b c", "été — à b  c d́ e", "x 's 'll I'll don't <|endoftext|> a", "日本 語 123 456\r\n 7 '7 's's", "w.\nNext,\n\nmore!!? |x|\n y", "\n", "a \nb  c"]


def test_encoder_agrees_with_the_tokenizer(corpus):
    from tokenizers import Tokenizer

    texts = [r["text"] for r in corpus.select("text").collect()] + TRICKY
    whole = Tokenizer.from_file(TOKENIZER)
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    for known in (700_000, 50):  # a table that is emptied all the time
        ids, sizes = sequences.Encoder(TOKENIZER, known=known).encode(pa.array(texts, pa.string()))
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_token_files(spark, corpus):
    from tokenizers import Tokenizer

    manifest = sequences.write_token_files(corpus, tokenizer_path=TOKENIZER, length=64)
    got = sequences.read_documents(manifest, with_ids=True).orderBy("start").collect()
    whole = Tokenizer.from_file(TOKENIZER)
    want = collections.Counter((r["doc_id"], tuple(whole.encode(r["text"] or "", add_special_tokens=False).ids + [0])) for r in corpus.select("doc_id", "text").collect())
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes()))
        at += r["n_tokens"]
    stream = []
    for m in manifest.orderBy("part").collect():
        for row in range(-(-m["tokens"] // 64)):
            x, mask = sequences.read_sequence(m["file"], row)
            assert len(x) == len(mask) == 64
            stream += x[mask].tolist()
    assert stream == [i for r in got for i in r["ids"]]
    empty = sequences.write_token_files(corpus.limit(0), tokenizer_path=TOKENIZER)
    assert sequences.read_documents(empty).count() == 0


def test_pipeline_stage_by_stage(spark, corpus, prose, tmp_path):
    import corpus_pipeline
    from test_dedup_and_mixing import brute_components
    from test_text_models import brute_passages

    docs = corpus.select("doc_id", "text", "lang", "source", "n_chars")
    items = [(0, prose("de", 25, 990)), (1, prose("en", 30, 991))]
    leak = spark.createDataFrame([(500, f"{prose('de', 40, 992)}\n{items[0][1]}", "de", "s1", 0)], docs.schema)
    docs = docs.unionByName(leak)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(now.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
    language, near, clean, mixed, tokens = kept
    before = {r["doc_id"] for r in docs.collect()}
    assert before - {r["doc_id"] for r in language} == {60, 61, 62, 64}
    groups = brute_components([(r["doc_id"], r["text"]) for r in language], 5, 80)
    assert sorted(str(r["doc_id"]) for r in near) == sorted(str(i) for i, _, c in groups if i == c)
    leaks = set(brute_passages([(r["doc_id"], r["text"]) for r in near], items))
    assert 500 in leaks and {r["doc_id"] for r in clean} == {r["doc_id"] for r in near} - leaks
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in clean} and mixed
    assert collections.Counter(r["doc_id"] for r in tokens) == collections.Counter(r["doc_id"] for r in mixed)
    assert sorted(r["start"] for r in tokens)[0] == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(tokens)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0
