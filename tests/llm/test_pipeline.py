"""The pipeline on a small folder of tables, against brute force at every stage."""

import random
import re

import corpus_pipeline
from probscape.llm import decontamination, packing, quality, tokens
from probscape.llm.queries import ORACLES, QUERIES, tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, stem="w"):
    return " ".join(rng.choice(["the", "of", "and", *(f"{stem}{k}" for k in range(300))]) for _ in range(n)).capitalize() + "."


def words(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def write(spark, folder):
    rng = random.Random(12)
    docs = [(i, prose(rng, rng.choice([20, 60, 120]))) for i in range(120)]
    docs += [(i, prose(rng, 40).upper().replace(" ", "!! ")) for i in range(120, 150)]
    docs += [(i, docs[i - 150][1].replace(" ", "\n" if i % 2 else "  ")) for i in range(150, 165)]
    for i in range(165, 180):
        text = docs[i - 120][1].split()
        text[3] = "changed"
        docs.append((i, " ".join(text)))
    items = [(k, prose(rng, 30, "q")) for k in range(6)]
    docs += [(i, f"{prose(rng, 50)} {items[i % 6][1]} {prose(rng, 50)}") for i in range(180, 190)]
    docs += [(190, None), (191, ""), (None, prose(rng, 30)), (192, prose(rng, 9000))]
    spark.createDataFrame([(*d, "xx", "s", len(d[1] or "")) for d in docs], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 120), 0) for i in range(0, 150)] + [(i, 1, 0) for i in range(150, 185)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def test_pipeline(spark, tmp_path):
    folder = str(tmp_path / "tables")
    items = write(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    path = tokenizer_path("byte_bpe_50k.json")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            ids = {i: [*tokens.tokenizer(path).encode(t or "", add_special_tokens=False).ids, 1] for i, t in before.items()}
            rows = out.collect()
            assert {(r.doc_id, r.doc_tokens) for r in rows} == {(i, len(x)) for i, x in ids.items()}
            assert sum(r.length for r in rows) == sum(map(len, ids.values()))
            assert len({r.sequence_id for r in rows}) == -(-sum(map(len, ids.values())) // 2048)
            break
        assert out.columns == docs.columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert out.count() == len(after) and after.items() <= before.items()
        gone = set(before) - set(after)
        if name == "quality":
            assert set(range(120, 150)) <= gone and len(gone - set(range(120, 150)) - {190, 191}) <= 2
        elif name == "exact_dedup":
            groups = {}
            for i, t in before.items():
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
            assert set(after) == {min(g)[3] for g in groups.values()}
        elif name == "near_dedup":
            sets, root = {i: words(t) for i, t in before.items() if i is not None}, {}
            for i in sorted(sets):
                linked = {root[j] for j in root if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
                low = min([i, *linked])
                root = {j: low if r in linked else r for j, r in root.items()} | {i: low}
            assert set(after) - {None} == set(root.values()) and (None in after) == (None in before) and len(gone) >= 5
        elif name == "decontamination":
            assert gone == {i for i, t in before.items() if t and any(decontamination.plain(x) in decontamination.plain(t) for _, x in items)} and len(gone) >= 9
        docs = out
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, whole.select("doc_id", "start", "length", "ids_crc32").collect()), key=str) == sorted(((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows), key=str)


def test_stages_are_the_ones_asked_for():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and callable(quality.keep_good) and callable(packing.pack)


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
