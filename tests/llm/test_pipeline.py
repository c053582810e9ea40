"""The pipeline's stages on a small corpus: clean documents stay, and each decision takes effect."""

import random

import pytest

import corpus_pipeline
from scenarium.llm.simhash import near_copy_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
KINDS = {float: "double", str: "string", int: "long", bool: "boolean"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    out = str(tmp_path_factory.mktemp("corpus"))
    text = lambda n: " ".join("".join(rng.choices(["ka", "ti", "mo", "re", "lu"], k=rng.randint(1, 5))) for _ in range(n))
    item = text(30)
    clean = [text(rng.randint(20, 80)) for _ in range(30)]
    texts = [*clean, clean[0], clean[1].upper(), f"{text(20)} {item} {text(20)}", f"{text(30)} ann@mail.example.com", None, "", "123 456 --"]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder):
    docs, left = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        left.append((name, docs.count()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
        if name == "pii_surrogates":
            assert not any("ann@mail.example.com" in r.text for r in docs.collect())
    assert left == [("language_id", 34), ("simhash_near_dedup", 32), ("benchmark_decontamination", 31), ("pii_surrogates", 31), ("byte_bpe", 31)]


def test_run_is_the_stages_in_order(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in out.collect()} == {*range(30), 33}


ODD = [
    (1, None), (2, ""), (3, " \n"), (4, "123 -- 456"), (None, None), (None, "kati more lu kati more tika relu moti kare luka"), (5, "kati more lu kati more tika relu moti kare luka"),
    (6, "moka tire lumo kati reka motire luti kamo rela timo"), (6, "moka tire lumo kati reka motire luti kamo rela timo"), (6, "reti luka moti kare tilu mokare tika lumo reka tilo"), (7, "tikamorelu " * 30_000),
]
CLASHING = {"score": 1.5, "lang_pred": "x", "digest": "d", "key": 3, "attempts": 4, "rare_id": 5, "n_replaced": 6, "component": 7, "node": 8, "least": 9, "f1": 1, "fp": 2, "n_tokens": 1, "held_out": True, "component_id": 3}


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_of_odd_rows(spark, folder, number):
    name, stage = corpus_pipeline.STAGES[number]
    extra = list(CLASHING) if name != "byte_bpe" else []
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t or ""), *(CLASHING[c] for c in extra)) for i, t in ODD], SCHEMA + "".join(f", {c} {KINDS[type(CLASHING[c])]}" for c in extra)).repartition(3)
    out = stage(spark, docs, folder)
    if name == "byte_bpe":
        assert sorted(r.doc_id or 0 for r in out.collect()) == sorted(i or 0 for i, _ in ODD)
    else:
        assert out.columns == docs.columns
        rows = sorted(((r.doc_id or 0, r.text) for r in out.collect()), key=str)
        every = sorted(((i or 0, t) for i, t in ODD), key=str)
        if name == "language_id":
            assert rows == [r for r in every if r[1] and any(c.isalpha() for c in r[1])]
        elif name == "simhash_near_dedup":  # one text without words, one of the copies that has an id, both texts of doc_id 6
            assert rows == sorted([(1, None), (4, ODD[3][1]), (5, ODD[6][1]), (6, ODD[7][1]), (6, ODD[9][1]), (7, ODD[10][1])], key=str)
        else:
            assert rows == every
        assert all(r[c] == CLASHING[c] for r in out.collect() for c in extra)
    nothing = stage(spark, docs.limit(0), folder)
    assert nothing.collect() == [] and (name == "byte_bpe" or nothing.columns == docs.columns)


def test_near_copies_go_and_their_first_stays(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices(["ka", "ti", "mo", "re", "lu", "sa"], k=rng.randint(2, 6)))
    texts, want = [], set()
    for n in (60, 100, 400, 1500):
        for _ in range(4):
            own = [word() for _ in range(n)]
            want.add(len(texts))
            texts.append(own)
            for edits in {1, n // 100, n // 60} - {0}:  # shingles of five words stay alike to 0.8 at least
                copy = list(own)
                for at in rng.sample(range(n), edits):
                    copy[at] = word()
                texts.append(copy)
    common = [word() for _ in range(150)]  # a crowd of copies of one text
    want.add(len(texts))
    texts.append(common)
    for _ in range(120):
        copy = list(common)
        for at in rng.sample(range(150), rng.randint(1, 2)):
            copy[at] = word()
        texts.append(copy)
    docs = spark.createDataFrame([(i, " ".join(t), "aa", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, None).collect()}
    assert want <= kept and len(kept - want) <= 0.02 * (len(texts) - len(want))


def test_near_copies_meet_in_a_crowd_of_texts_of_the_same_words(spark):
    rng = random.Random(5)
    words, texts = [f"w{i}" for i in range(120)], []
    for _ in range(20):  # one fingerprint, but no shingle in common
        own = rng.sample(words, 120)
        copy = list(own)
        copy[60] = rng.choice(words)
        texts += [own, copy]
    docs = spark.createDataFrame([(i, " ".join(t), "aa", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, None).collect()}
    assert kept == set(range(0, 40, 2))


def rows_of_joins(spark, job):
    """Most rows that a join of ``job`` made."""
    store = spark._jsparkSession.sharedState().statusStore()
    listed = lambda seq: [seq.apply(i) for i in range(seq.size())]
    before = {e.executionId() for e in listed(store.executionsList())}
    job()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most = 0
    for e in listed(store.executionsList()):
        if e.executionId() not in before:
            values = store.executionMetrics(e.executionId())
            for node in listed(store.planGraph(e.executionId()).allNodes()):
                for metric in listed(node.metrics()) if "Join" in node.name() else ():
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most


def crowd_of_orders(rng, orders):
    """Texts of the same words, which share all postings, in families of three near copies."""
    words, texts = [f"w{i}" for i in range(120)], []
    for _ in range(orders):
        own = rng.sample(words, 120)
        texts.append(own)
        for at in (40, 80):
            copy = list(own)
            copy[at] = rng.choice(words)
            texts.append(copy)
    return [" ".join(t) for t in texts]


def test_joins_make_few_rows_for_each_text_of_a_crowd(spark):
    texts = crowd_of_orders(random.Random(6), 60)
    docs = spark.createDataFrame([(i, t, "aa", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    kept = set()
    assert rows_of_joins(spark, lambda: kept.update(r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, None).collect())) <= 20 * len(texts)
    assert kept == set(range(0, len(texts), 3))


@pytest.mark.parametrize("block", [8, 40, 2048])
def test_blocks_of_a_crowd_are_all_compared(spark, block):
    texts = crowd_of_orders(random.Random(7), 25)
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "digest long, doc_id long, text string").repartition(3)
    found = {r.digest: r.component for r in near_copy_groups(docs, block=block).collect()}
    assert found == {i: i - i % 3 for i in range(len(texts))}
