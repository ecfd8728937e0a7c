import hashlib
import re

import corpus_pipeline as p
from mosaiq.llm import mixing, quality_classifier, simhash
from mosaiq.llm.queries import byte_tokenizer
from mosaiq.plans import lineage
from tests.llm.test_near_texts import brute

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_stages_against_their_operators(spark, sf_dir, documents, tmp_path):
    docs, tables = documents, []
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        tables.append(docs)
        if k < 4:
            assert docs.columns == documents.columns
    quality, single, masked, mixed, coded = tables
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_classifier.scored(documents, quality_classifier.train(documents, labels), "made").collect()
    assert sorted(r.doc_id for r in quality.collect()) == sorted(r.doc_id for r in scored if r.made >= 0.3)
    prints = {r.doc_id: r.component_id for r in simhash.near_duplicates(quality).collect()}
    texts = {r.doc_id: r.text for r in quality.collect()}
    ids = sorted(texts)
    whole, _ = brute([texts[k] for k in ids], [prints[k] for k in ids])
    assert sorted(r.doc_id for r in single.collect()) == sorted({min(k for k, c in zip(ids, whole) if c == one) for one in set(whole)})
    before, after = {r.doc_id: r for r in single.collect()}, {r.doc_id: r for r in masked.collect()}
    assert before.keys() == after.keys()
    for k, r in after.items():
        assert not any(len(m[2]) >= 6 for m in ASSIGN.finditer(r.text)) and not re.search("[0-9a-f]{24}", r.text) and r.n_chars == len(r.text)
        assert ("[secret]" in r.text) == (r.text != before[k].text)
    taken = {r.doc_id: (r["size"], r.taken) for r in mixing.mixed_documents(masked).collect()}
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(times.get(k, 0) == (round(t / n + 1e-12) if n else 1) or abs(t / n % 1 - 0.5) < 1e-9 for k, (n, t) in taken.items())
    again = byte_tokenizer(spark).decode(coded, decoded="back").collect()
    assert len(again) == mixed.count() and all(bytes(r.back).decode() == (r.text or "") and len(r.token_ids) == 4 * r.n_tokens for r in again)


def test_run_and_registration(spark, sf_dir):
    import __spark_entry__

    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in __spark_entry__.queries() if re.match(r"op\d+_", q)}
    first, second = (sorted(hashlib.sha256(bytes(r.token_ids)).hexdigest() for r in p.run(spark, sf_dir).collect()) for _ in range(2))
    assert first == second


def test_odd_rows(spark, odd, empty, sf_dir):
    """Each stage on nulls, blank and very long texts, ties and repeated rows: what its docstring says."""
    kept = lambda stage, docs: stage(spark, docs, sf_dir).collect()
    known = {tuple(r) for r in odd.collect()}
    quality = kept(p.quality, odd)
    assert {tuple(r) for r in quality} <= known and len({r.doc_id for r in quality if r.doc_id in (1, 2)}) in (0, 2)
    single = kept(p.near_dedup, odd)
    assert len(single) == len({r.text if r.text and r.text.strip() else "" for r in odd.collect()}) and {tuple(r) for r in single} <= known
    masked = kept(p.secret_masks, odd)
    assert sorted(map(str, masked)) == sorted(map(str, odd.collect()))
    mixed = kept(p.mix_sources, odd)
    assert {tuple(r) for r in mixed} <= known and sum(not (r.text or "").strip() for r in mixed) == sum(not (r.text or "").strip() for r in odd.collect())
    coded = kept(p.tokens, odd)
    assert len(coded) == odd.count() and all((r.n_tokens == 0) == (not r.text) and len(r.token_ids) == 4 * r.n_tokens for r in coded)
    assert [len(kept(stage, empty)) for _, stage in p.STAGES] == [0] * 5


def test_near_dedup_leaves_few_tables(spark, documents, tmp_path, monkeypatch):
    """Later stages have the disk for themselves: of what near-dedup writes on the way only tables that its result reads stay."""
    monkeypatch.setattr(lineage, "shared_dir", lambda spark: str(tmp_path))
    kept = p.near_dedup(spark, documents.limit(200), "")
    assert kept.count() > 0 and len(list(tmp_path.iterdir())) <= 3
