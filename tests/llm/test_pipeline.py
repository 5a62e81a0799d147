"""The pipeline on the smallest tables, held against what its stages must do."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_operators import exact_components

import corpus_pipeline as pipeline
from quillmark.llm import bpe, secrets, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_keep_columns(spark, docs):
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0, name


def test_decisions(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    left = pipeline.drop_contaminated(spark, docs, SF).select("doc_id", "text").collect()
    flat = lambda t: " ".join(t.lower().split())
    items = [flat(b["text"]) for b in bench]
    assert not [d for d in left if any(i in flat(d["text"]) for i in items)]
    clean = [d["doc_id"] for d in docs.collect() if not any(i[:-1] in flat(d["text"]) for i in items)]
    assert set(clean) <= {d["doc_id"] for d in left}
    hidden = pipeline.redact_secrets(spark, docs, SF)
    assert hidden.count() == docs.count() and hidden.where(F.col("text").rlike("[0-9a-f]{16}|AKIA[A-Z0-9]{14}")).count() == 0
    same = hidden.join(docs.select("doc_id", F.col("text").alias("before"), F.col("n_chars").alias("n_before")), "doc_id")
    assert same.where("text = before and n_chars <> n_before or text <> before and n_chars <> length(text)").count() == 0


def overlaps(own, item, window=12, percent=80):
    """Whether some run of places agrees enough, at any offset."""
    size = min(window, len(item))
    at = defaultdict(list)
    for j, word in enumerate(item):
        at[word].append(j)
    by_offset = defaultdict(set)
    for i, word in enumerate(own):
        for j in at.get(word, ()):
            by_offset[i - j].add(j)
    for offset, places in by_offset.items():
        low, high = max(0, -offset), min(len(item), len(own) - offset)
        if any(100 * len(places & set(range(s, s + size))) >= percent * size for s in range(low, high - size + 1)):
            return True
    return False


def by_hand(docs, labels, items, secret_model):
    """The pipeline's rows, document by document: the library's encoding, exact likeness, every window against every item."""
    from tokenizers import Tokenizer

    toxic = {r["doc_id"]: r["toxic"] for r in labels if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    learnt = sorted((d for d in docs if d["doc_id"] in toxic), key=lambda d: d["doc_id"])
    judge = toxicity.Judge(toxicity.train([toxicity.windows(d["text"] or "") for d in learnt], [toxic[d["doc_id"]] for d in learnt]))
    left = [d for d in docs if judge.score(d["text"] or "") < 0.7]
    component = exact_components({d["doc_id"]: d["text"] for d in left}, 5, 80)[0]
    left = [d for d in left if component[d["doc_id"]] == d["doc_id"]]
    words = lambda t: (t or "").lower().split()
    left = [d for d in left if not any(overlaps(words(d["text"]), words(i["text"])) for i in items if words(i["text"]))]
    library, out = Tokenizer.from_file(bpe.vocabulary_path()), {}
    for d in left:
        found = secrets.spans(d["text"] or "", secret_model)
        text = secrets.hidden(d["text"], found, "[SECRET]") if found else d["text"]
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        out[d["doc_id"]] = (d["lang"], d["source"], len(text) if found else d["n_chars"], len(ids), b"".join(i.to_bytes(4, "little") for i in ids), hashlib.sha256(decoded.encode()).hexdigest())
    return out


def test_run_equals_version_by_hand(spark, docs):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()
    out = pipeline.run(spark, SF).collect()
    # What the secret models learn from is what the stage is given; only their markov spans depend on it, and these are rare.
    want = by_hand(docs.collect(), read("labels"), read("benchmark"), secrets.train(secrets.sampled(docs, 4000)))
    got = {r["doc_id"]: (r["lang"], r["source"], r["n_chars"], r["n_tokens"], bytes(r["token_ids"]), r["decoded_sha256"]) for r in out}
    assert len(out) == len(got) and got == want


def test_stages_on_odd_tables(spark, docs):
    """Nulls, empty, blank and long texts, repeated rows, a row without an id, clashing columns, and an empty table."""
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "lorem ipsum dolor " * 20_000), (5, "password = abcdef0123456789"), (5, "password = abcdef0123456789"), (None, "no id here at all"), (7, "Ünïcödé 漢字 😀")]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    for c in ("__toxicity", "__redacted", "__decoded", "__source_text", "token_ids", "n_tokens", "redacted_text", "kept", "offset", "seed"):
        odd = odd.withColumn(c, F.lit("mine"))
    for name, stage in pipeline.STAGES:
        for given in (odd, odd.where("false")):
            out = stage(spark, given, SF)
            outputs = {"token_ids", "n_tokens"} if name == "bpe" else set()
            assert {c for c in given.columns if c != "text" or name != "bpe"} <= set(out.columns), name
            left = out.collect()
            assert len(left) == given.count() - (name == "near_dedup" and given is odd), name
            assert all(r[c] == "mine" for r in left for c in odd.columns[5:] if c not in outputs), name
            if name == "secrets" and left:
                assert [r["text"] for r in left if r["doc_id"] == 5] == ["[SECRET]"] * 2 and [r["n_chars"] for r in left if r["doc_id"] == 5] == [8, 8]


def test_run(spark, docs):
    out = pipeline.run(spark, SF)
    assert 0 < out.count() <= docs.count()
    assert out.where("n_tokens * 4 <> octet_length(token_ids)").count() == 0
    assert out.groupBy("doc_id").count().where("count > 1").count() == 0


def test_stages_send_each_text_to_workers_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    for stage in (pipeline.drop_toxic, pipeline.redact_secrets, pipeline.encode_tokens):
        plan = stage(spark, docs, SF)._jdf.queryExecution().optimizedPlan()
        while plan.nodeName() != "MapInArrow":
            plan = plan.children().head()
        given = plan.children().head().output()
        assert len([i for i in range(given.size()) if given.apply(i).name() in {"text", "__source_text", "__given"}]) == 1, stage.__name__
