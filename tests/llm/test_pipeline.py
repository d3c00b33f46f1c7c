"""The pipeline's rows against plain versions of its stages, and its stages on awkward tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from umbra.llm import packing, pii

from .test_table_operators import plain_classes, plain_plan, words
from .test_text_operators import naive_pii, plain_verdicts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(41)
    pool = "the of water house went under many people found little north garden stone light river field morning letter window table".split()
    plain = lambda n: " ".join(rng.choice(pool, n)) + f" {words(rng, 12)}"
    rows = [[plain(int(n)), "en", ("web", "web", "web", "books")[i % 4]] for i, n in enumerate(rng.integers(60, 140, 60))]
    private = ["write to jo@mail.com or di@mail.org", "from 10.0.0.1 and 192.0.2.77", "card 4111 1111 1111 1111", "call +1 (212) 555-0100 now"]
    for i, p in enumerate(private * 2):
        rows[5 * i][0] += " " + p
    near = [[t + " at the end", lang, s] for t, lang, s in rows[10:16]]
    copies = [list(r) for r in rows[20:24]] * 2
    junk = [[" ".join("".join(map(chr, rng.integers(0x21, 0x7E, 8))) for _ in range(80)), "en", "web"] for _ in range(4)] + [["too short", "en", "web"], [None, "en", None], ["", None, "web"], ["same words again " * 60, "en", "books"]]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, (t, lang, s) in enumerate(rows + near + copies + junk)]


def plain_mask(text):
    out, at = "", 0
    for start, end, kind in sorted(((s, e, k) for k, v in naive_pii(text).items() for s, e in v), key=lambda x: (x[0], -x[1])):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
            at = end
    return out + text[at:]


def stages(spark, df, upto):
    for _, stage in corpus_pipeline.STAGES[:upto]:
        df = corpus_pipeline.materialise(stage(spark, df, "unused"))
    return df


def test_pipeline_against_plain_stages(spark, corpus):
    from tokenizers import Tokenizer

    df = spark.createDataFrame(corpus, DOCS).repartition(4)
    kept = [r for r, (_, ok) in zip(corpus, plain_verdicts([(t, lang) for _, t, lang, *_ in corpus])) if ok]
    good = stages(spark, df, 1)
    assert good.columns == df.columns and sorted(r["doc_id"] for r in good.collect()) == [r[0] for r in kept] and 8 <= len(corpus) - len(kept) < 30
    classes = plain_classes([(i, t) for i, t, *_ in kept])
    single = [r for r in kept if classes[r[0]] == r[0]]
    assert len(kept) - len(single) >= 14
    alone = corpus_pipeline.materialise(corpus_pipeline.STAGES[1][1](spark, good, "unused"))
    assert sorted(r["doc_id"] for r in alone.collect()) == [r[0] for r in single]
    masked = [(i, plain_mask(t), lang, s, len(plain_mask(t))) for i, t, lang, s, _ in single]
    hidden = corpus_pipeline.materialise(corpus_pipeline.STAGES[2][1](spark, alone, "unused"))
    assert sorted(tuple(r) for r in hidden.collect()) == masked and sum(t != r[1] for (_, t, *_), r in zip(single, masked)) >= 6
    mixed = corpus_pipeline.materialise(corpus_pipeline.STAGES[3][1](spark, hidden, "unused"))
    times = Counter(i for i, *_ in plain_plan(spark, masked, 2.0))
    assert Counter(tuple(r) for r in mixed.collect()) == Counter({r: times[r[0]] for r in masked})
    packed = corpus_pipeline.STAGES[4][1](spark, mixed, "unused").toPandas()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    for i, t, *_ in masked:
        own = packed[packed.doc_id == i]
        assert set(own.doc_tokens) == {len(tokenizer.encode(t, add_special_tokens=False).ids) + 1} and own.length.sum() == times[i] * own.doc_tokens.iloc[0]
    assert packed.groupby("sequence_id").length.sum().max() <= packing.SEQ and packed.length.sum() == sum(times[i] * n for i, n in packed.groupby("doc_id").doc_tokens.first().items())


def test_stages_of_nulls_ties_long_texts_and_clashing_columns(spark):
    rng = np.random.default_rng(43)
    text = " ".join(rng.choice("the of water house went under many people found little".split(), 90)) + " " + words(rng, 30)
    long = words(rng, 60_000) + " jo@mail.com"
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, None, None, None, None), (2, long, None, None, None), (None, text + " " + words(rng, 90), "en", None, 5), (3, "", "", "", 0)]
    df = spark.createDataFrame(rows, DOCS)
    for clash in ("key", "digest", "kept", "pii", "epoch", "__umbra_row", "block", "comp", "bands"):
        df = df.withColumn(clash, F.lit("clash"))
    found = df
    for (name, stage), least in zip(corpus_pipeline.STAGES[:-1], (3, 3, 3, 3)):
        found = corpus_pipeline.materialise(stage(spark, found, "unused"))
        assert found.columns == df.columns and found.count() >= least and found.where("digest != 'clash'").count() == 0, name
    assert found.where("doc_id = 2 and text like '%[EMAIL]'").count() >= 1
    packed = corpus_pipeline.STAGES[-1][1](spark, found, "unused")
    assert packed.where("doc_id = 2").count() > 29 and packed.where("doc_id is null").count() >= 1
    empty = df.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "unused").count() == 0, name


def test_masks_of_the_plain_version_are_the_operators():
    for text in ("jo@mail.com 4111 1111 1111 1111", "+49 30 1234567 at 1.2.3.4", "nothing"):
        assert plain_mask(text) == pii.mask_text(text, 0.0)
