"""The opN queries themselves on the smallest tables: columns, types, and what their contracts say of each row."""

import hashlib
import zlib
from collections import Counter

import duckdb
import pytest

from evmatch.llm import catalog

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op2_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op3_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op4_html": "page_id bigint, url string, text string, n_chars bigint",
    "op5_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_suffixes": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op9_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op11_periodicity": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op12_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op13_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op10_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
}


@pytest.fixture(scope="module")
def results(spark):
    out = {}
    for name, query in catalog.queries().items():
        df = query(spark, SF)
        out[name] = (", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), df.collect())
    return out


@pytest.fixture(scope="module")
def texts():
    return {i: t or "" for i, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()}


def test_columns_and_types(results):
    assert {name: kinds for name, (kinds, _) in results.items()} == COLUMNS


def test_every_document_once(results, texts):
    for name in ("op1_simhash", "op2_media", "op3_sharding", "op5_quality", "op6_toxicity", "op7_suffixes", "op8_mixing", "op11_periodicity", "op13_decontamination"):
        assert sorted(r["doc_id"] for r in results[name][1]) == sorted(texts), name
    assert {r["doc_id"] for r in results["op10_packing"][1]} == set(texts)


def test_media_rows(results, texts):
    for r in results["op2_media"][1]:
        data = texts[r["doc_id"]].encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


@pytest.mark.parametrize("name, parts, rest, column", [("op5_quality", 3, 1, "quality"), ("op6_toxicity", 5, 0, "toxic")])
def test_scores(results, name, parts, rest, column):
    labels = dict(duckdb.sql(f"select doc_id, {column} from '{SF}/labels.parquet'").fetchall())
    held = []
    for r in results[name][1]:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == rest)
        if r["held_out"] and r["doc_id"] in labels:
            held.append(r["predicted"] == labels[r["doc_id"]])
    assert held and sum(held) >= 0.9 * len(held)


def test_rows_of_the_others(results, texts):
    full = Counter()
    for r in sorted(results["op10_packing"][1], key=lambda r: r["offset"]):
        assert r["offset"] == full[r["sequence_id"]]
        full[r["sequence_id"]] += r["length"]
    assert max(full.values()) <= 2048
    for r in results["op7_suffixes"][1]:
        data = texts[r["doc_id"]].encode()
        assert r["n_bytes"] == len(data) and (r["n_removed"] > 0) == (r["n_spans"] > 0)
        assert r["n_removed"] or r["kept_sha256"] == hashlib.sha256(data).hexdigest()
    ranks = Counter(r["query_id"] for r in results["op9_topk"][1])
    assert all(i % 100 == 0 and n == 10 for i, n in ranks.items())
    assert all(r["n_chars"] == len(r["text"]) > 0 for r in results["op4_html"][1])


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_against_their_sql(results, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    expected = c.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(k.split()[0] for k in COLUMNS[name].split(", "))
    assert sorted(str([r[k] for k in columns]) for r in results[name][1]) == sorted(str(list(r)) for r in expected.fetchall())
