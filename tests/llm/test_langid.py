import random
import re

from skein.llm import langid
from tests.llm.util import awkward, clashing, empty, rows, same_rows, SCHEMA

WORDS = {"en": "the and with from this that have which their would there house water light".split(), "de": "der die und nicht mit auch sich werden können haus wasser straße über".split(), "es": "el los que para con una más también porque casa agua señor año".split()}


def corpus(n=30, size=80, seed=1):
    r = random.Random(seed)
    return [(lang, " ".join(r.choice(w) for _ in range(size))) for lang, w in WORDS.items() for _ in range(n)]


def docs(spark, texts):
    data = []
    for i, (lang, t) in enumerate(texts):
        row = list(rows([t])[0])
        row[0], row[2] = i, lang
        data.append(tuple(row))
    return spark.createDataFrame(data, SCHEMA)


def test_held_out_accuracy_and_rejection(spark):
    model = langid.train(docs(spark, corpus()))
    held = corpus(20, 30, seed=2)
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, held), model).collect()}
    assert sum(got[i]["language"] == lang for i, (lang, _) in enumerate(held)) >= 59
    assert all(r["keep"] for r in got.values())
    noise = [(None, "".join(random.Random(i).choice("qxzjkvwyp") for _ in range(400))) for i in range(5)]
    assert not any(r["keep"] for r in langid.identify(docs(spark, noise), model).collect())


def test_phrases_equal_a_plain_parse(spark):
    model = langid.train(docs(spark, corpus()))
    text = "der die haus wasser xyz the"
    (r,) = langid.identify(docs(spark, [(None, text)]), model).collect()
    assert r["letters"] == sum(c.isalpha() for c in text)
    assert abs(r["rate"] - r["phrases"] / r["letters"]) < 1e-12


def test_awkward_and_empty_tables(spark):
    model = langid.train(awkward(spark))
    got = langid.identify(awkward(spark), model).collect()
    assert len(got) == 12
    assert all(not r["keep"] and r["language"] is None for r in got if r["letters"] == 0)
    assert langid.identify(empty(spark), model).count() == 0
    nothing = langid.train(empty(spark))
    kept = langid.keep_identified(awkward(spark), nothing)
    assert kept.count() == 12 and kept.columns == awkward(spark).columns


def parse(text: bytes, sample: bytes) -> list[int]:
    """Where phrases begin: longest matches in the sample, one after another; a symbol that isn't there is a phrase of its own."""
    i, out = 0, []
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i: j + 1] in sample:
            j += 1
        out.append(i)
        i = j
    return out


def brute(texts, model):
    out = {}
    for i, t in enumerate(texts):
        folded = re.sub(rb"[^a-z\x80-\xff]+", b" ", (t or "").lower().encode()).lstrip(b" ")
        letters = len(folded.replace(b" ", b""))
        begins = {lang: parse(folded, model.samples[lang]) for lang in model.languages}
        best = min(begins, key=lambda k: (len(begins[k]), k)) if letters else None
        rate = len(begins[best]) / letters if letters else None
        least = sum(min(sum(a <= x < a + langid.PART_BYTES for x in b) for b in begins.values()) for a in range(0, len(folded), langid.PART_BYTES))
        limit = model.reject_rate + 3 * (model.reject_rate / letters) ** 0.5 if letters else 0
        out[i] = (best, rate, letters > 0 and least / letters <= limit)
    return out


def test_a_text_in_two_languages_is_kept(spark):
    model = langid.train(docs(spark, corpus()))
    en, de = (next(t for lang, t in corpus(1, 300, seed=9) if lang == x) for x in ("en", "de"))
    (r,) = langid.identify(docs(spark, [(None, en + " " + de)]), model).collect()
    assert r["keep"]


def test_every_answer_equals_a_plain_parse(spark):
    model = langid.train(docs(spark, corpus()))
    r = random.Random(4)
    texts = [t for _, t in corpus(6, 25, seed=3)] + ["".join(r.choice("qxzjk vwy9,") for _ in range(60)) for _ in range(6)] + ["The HOUSE, die straße 12", "", None, "###", "q"]
    got = {x["doc_id"]: (x["language"], x["rate"], x["keep"]) for x in langid.identify(docs(spark, [(None, t) for t in texts]), model).collect()}
    assert got == brute(texts, model)


def test_sampled_documents_are_whole(spark):
    texts = corpus(40, 60)
    model = langid.train(docs(spark, texts), train_bytes=2_000)
    whole = {lang: [re.sub(r"[^\w]+", " ", t).encode() for x, t in texts if x == lang] for lang in model.languages}
    for lang, sample in model.samples.items():
        assert 0 < len(sample) <= 2_000
        rest = sample
        for t in whole[lang]:
            rest = rest.replace(t, b"")
        assert rest.strip() == b""
    tiny = langid.train(docs(spark, texts), train_bytes=5)  # nothing fits: the shortest, whole
    assert all(tiny.samples[lang] in whole[lang] for lang in whole)


def test_names_of_other_columns_are_kept(spark):
    model = langid.train(clashing(spark))
    kept = langid.keep_identified(clashing(spark), model)
    assert kept.columns == clashing(spark).columns
    same_rows(kept, clashing(spark))
