import base64
import random

import numpy as np
import pyarrow as pa

from weftline.llm import langid
from weftline.llm.common import utf8

SMALL = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = langid.op2_language_id(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    import zlib

    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]).all()
    held = out[out["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert out["score"].between(0, 1).all() and out["accepted"].mean() > 0.995


#: The first article of the Universal Declaration of Human Rights in languages that no document has, and texts in none.
FOREIGN = {
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím.",
    "zh": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "c": "int main(void) { for (size_t i = 0; i < n; ++i) { buf[i] = malloc(sizeof *ptr); if (!buf[i]) return errno; } }",
    "base64": base64.b64encode(random.Random(1).randbytes(300)).decode(),
    "hex": " ".join(random.Random(i).randbytes(16).hex() for i in range(8)),
    "letters": " ".join("".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=6)) for i in range(40)),
    "noise": langid.noise("a noise text, whose own words are of no matter"),
}


def test_rejection(spark):
    """Texts in no learned language go; of held-out documents nearly all stay."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.train(docs.select("doc_id", "text", "lang"))
    texts = spark.createDataFrame(list(FOREIGN.items()), "name string, text string")
    went = {r["name"] for r in langid.identify(texts, model, ["name"]).where("NOT accepted").collect()}
    assert len(went) >= 0.9 * len(FOREIGN), FOREIGN.keys() - went
    held = docs.where("crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 = 0").select("doc_id", "lang", "text")
    out = langid.identify(held, model, ["lang"]).toPandas()
    assert out["accepted"].mean() > 0.995 and (out["lang"] == out["lang_pred"])[out["accepted"]].mean() > 0.98


def test_layout_does_not_count(spark, tmp_path):
    """The same model, byte for byte, from any number of partitions and from a table written anew, with rows that repeat."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    one = docs.orderBy("doc_id").limit(1)
    docs = docs.unionByName(one.crossJoin(spark.range(3000)).drop("id"))
    docs.repartition(5, "text").sortWithinPartitions("text").write.parquet(str(tmp_path / "anew"))
    models = [langid.train(x) for x in (docs.coalesce(1), docs.repartition(7), docs.repartition(16, "lang", "doc_id"), spark.read.parquet(str(tmp_path / "anew")))]
    m = models[0]
    assert m.langs and all((o.langs, o.temperature, o.threshold, o.table.tobytes(), o.bias.tobytes()) == (m.langs, m.temperature, m.threshold, m.table.tobytes(), m.bias.tobytes()) for o in models)


def test_many_languages_and_hot_rows(spark):
    """A dirty lang column makes as many classes as rows are drawn, at most; a row that repeats is drawn by its share."""
    rows = [(i, f"word{i} text of its own", f"l{i}") for i in range(200)]
    assert len(langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), 20).langs) < 60
    same = [(1, "the same text here", "a")] * 500 + [(i, f"other text number {i}", "b") for i in range(2, 500)]
    assert langid.train(spark.createDataFrame(same, "doc_id bigint, text string, lang string"), 40).langs == ["a", "b"]


def test_noise_is_of_the_text_alone():
    made = [langid.noise(f"text number {i} with letters") for i in range(40)]
    assert made == [langid.noise(f"text number {i} with letters") for i in range(40)] and len(set(made)) == 40
    assert isinstance(langid.noise(""), str) and langid.noise("0 1!") is not None


def test_odd(spark, sf):
    got = {(r["doc_id"], r["lang_pred"] == "und", r["score"] == 0, r["accepted"]) for r in langid.op2_language_id(spark, sf[0]).collect()}
    assert {(2, True, True, False), (3, True, True, False), (9, True, True, False)} <= got
    assert all(not und for i, und, _, _ in got if i in (1, 6, 7, 8))


def test_letters_beyond_ascii():
    raw, off = utf8(pa.array(["...", "中", "€", None, "a1", "é"]))
    assert langid.has_letter(raw, off).tolist() == [False, True, False, False, True, True]


def test_prediction_is_the_mean_of_features(spark):
    texts = ["Hello big wide world", "oh", "été là", "a"]
    model = langid.train(spark.read.parquet(f"{SMALL}/documents.parquet"))
    raw, off = utf8(pa.array(texts))
    best, score = model.predict(raw, off)
    for i, t in enumerate(texts):
        one, first = langid.ngrams(*utf8(pa.array([t])))
        h = np.concatenate([g[g < langid.BUCKETS] for g in one])
        p = langid.softmax((model.table[h].astype(np.float64).mean(axis=0) + model.bias) / model.temperature)
        assert len(p) == len(model.langs) + 1  # the last is none of them
        assert best[i] == p[:-1].argmax() and abs(score[i] - p[:-1].max()) < 1e-5


def test_ngrams_stay_within_words():
    raw, off = utf8(pa.array(["ab c", "d"]))
    grams, _ = langid.ngrams(raw, off)
    # " a", "ab", "b ", " c", "c ", " d", "d "; " ab", "ab ", " c ", " d "; " ab "
    assert [int((g < langid.BUCKETS).sum()) for g in grams] == [7, 4, 1]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    model = langid.train(docs)
    assert [tuple(r) for r in langid.identify(docs, model, ["doc_id"]).collect()] == [(1, "und", 0.0, False)]
