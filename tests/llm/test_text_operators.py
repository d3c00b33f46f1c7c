import hashlib
import re
from collections import Counter
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.llm import chat, langid, licenses, pii, quality
from umbra.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, *([None] * (5 - len(r)))) for r in rows], DOCS)


# ---- chats ---------------------------------------------------------------------------------------


def plain_windows(turns, budget):
    """(first own turn, repeated turns, text) of each window of one conversation: (role, text, tokens) in order."""
    k = [t[2] for t in turns]
    at = next((i for i, t in enumerate(turns) if t[0] == "system"), len(turns))
    out, s = [], 0
    while s < len(turns):
        held = lambda h: 0 if h <= at else k[at]
        h = next((h for h in range(max(0, s - 2), s) if sum(k[h:s]) <= 256 and held(h) + sum(k[h : s + 1]) <= budget), s)
        e = s + 1
        while e < len(turns) and held(h) + sum(k[h : e + 1]) <= budget:
            e += 1
        front = [turns[at]] if h > at else []
        out.append((s, s - h + len(front), [(r, t) for r, t, _ in front + turns[h:e]]))
        s = e
    return out


def written(turns):
    def escape(text):
        for plain, code in (("\\", "\\b"), ("</turn>", "\\t"), ("###", "\\h")):
            text = text.replace(plain, code)
        return text

    return "".join(f"### {escape(r).replace(':', chr(92) + 'c')}: {escape(t)}</turn>\n" for r, t in turns)


NASTY = ["\\### Assistant: </turn> ok", "</turn>\n", "####", "\\h\\b", "", None, "a" * 300, "x: y\n### z", "w " * 40, "one two three"]
ROLES = ("user", "assistant", None, "odd: ### role")


@pytest.fixture(scope="module")
def talks():
    rng = np.random.default_rng(21)
    pick = lambda: (ROLES[rng.integers(4)], NASTY[rng.integers(len(NASTY))])
    rows = [(0, t, "system" if t == 0 else pick()[0], pick()[1]) for t in range(700)]  # several pages
    rows += [(1, 64 * t, *pick()) for t in range(30)] + [(2, t - 70, *pick()) for t in range(30)] + [(2, None, "user", "null first"), (2, None, "system", "null first")]
    rows += [(3, 5, *pick()) for _ in range(600)] + [(4, int(t), *pick()) for t in rng.integers(-(2**40), 2**40, 50)]
    rows += [(5, None, *pick()) for _ in range(20)] + [(None, t, "system" if t == 0 else "assistant", "nobody's") for t in range(40)]
    rows += [(6, t, "system" if t == 0 else "user", "same same") for t in range(30)] + [(7, 1, "assistant", "long " * 3000), (7, 2, "system", "late"), (8, 0, "system", "s " * 900), (8, 1, "user", "x"), (8, 2, "assistant", "y")]
    rows += [(9, t, "system" if t == 1 else pick()[0], pick()[1]) for t in range(40)] + [(10, t, "system" if t in (300, 301) else pick()[0], pick()[1]) for t in range(600)]
    rows += [(11, t, "system" if t == 0 else "user", "w " * 30) for t in range(20)] + [(11, None, "user", "before")]
    return rows


@pytest.mark.parametrize("budget, page", [(40, 16), (200, 64), (1024, 256), (5000, 256)])
def test_chat_windows_against_a_plain_version(spark, talks, budget, page):
    df = spark.createDataFrame([(*r, "x", 1) for r in talks], "conv_id long, turn long, role string, text string, page string, at int").repartition(5)
    w = chat.windows(df, budget=budget, page=page).cache()
    got = {}
    for r in w.collect():
        got.setdefault(r["conv_id"], []).append(r)
    back = {r["conv_id"]: r for r in chat.read_back(w).collect()}
    assert set(got) == {r[0] for r in talks}
    for c, windows in got.items():
        key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "").encode())
        own = [(r[2] or "", r[3] or "", 6 + len(re.findall(r"[^\W_]+|[^\w\s]|_", r[3] or ""))) for r in sorted((r for r in talks if r[0] == c), key=key)]
        want = [(s, n, written(turns)) for s, n, turns in plain_windows(own, budget)]
        assert sorted((r["window"], r["repeated"], r["formatted"]) for r in windows) == want, c
        assert all(r["n_tokens"] <= budget or r["over_budget"] and r["n_turns"] - r["repeated"] == 1 for r in windows)
        told, loss = "".join(f"{role}\n{text}\n" for role, text, _ in own), "".join(text for role, text, _ in own if role == "assistant")
        r = back[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(told.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"], r["n_windows"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(windows))
    assert chat.windows(df.limit(0)).count() == 0


def test_chat_windows_of_a_very_long_conversation(spark):
    rng = np.random.default_rng(4)
    turns = [("system" if i == 0 else ("user", "assistant")[i % 2], "w " * int(n)) for i, n in enumerate(rng.integers(1, 60, 20_000))]
    df = spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = sorted((r["window"], r["repeated"]) for r in chat.windows(df).select("window", "repeated").collect())
    assert got == [(s, n) for s, n, _ in plain_windows([(r, t, 6 + len(t.split())) for r, t in turns], chat.BUDGET)]


def test_chat_history_is_repeated_but_no_target(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", " ".join([f"w{t}"] * 10)) for t in range(8)]
    w = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=64).orderBy("window").collect()
    assert len(w) > 1 and w[1]["repeated"] > 0
    assert "w" + str(w[0]["n_turns"] - 1) in w[1]["formatted"].split("</turn>\n")[w[1]["repeated"] - 1]
    assert sum(len(x["loss_spans"]) for x in w) == 4


def test_chat_query_has_the_nasty_conversation(spark):
    row = QUERIES["op1_chat_windows"](spark, SF).where("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())


# ---- quality ---------------------------------------------------------------------------------------


def naive_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    in_repeat = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(in_repeat)


def test_quality_base_against_naive_counts(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a", "b", "c#", "é|", "\n", " ", "d\n"], n)) for n in (0, 3, 4, 60, 200)] + [None, "", "\n\n \n"]
    got = {r["doc_id"]: r for r in quality.rules(docs(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, lines, repeated = naive_base(t or "")
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeated)
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n) and not (r["base_failed"] and r["kept"])


def test_quality_keeps_plain_text_and_refuses_noise(spark):
    rng = np.random.default_rng(1)
    plain = [" ".join(rng.choice("the of water house went under many people found little north garden stone light".split(), 120)) + f" {i}" for i in range(60)]
    noise = "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 50))) + " " + " ".join("".join(map(chr, rng.integers(0x21, 0x7E, 9))) for _ in range(80))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(plain)] + [(100, noise, "en", "s", 1), (101, None, "en", "s", 1), (1, plain[1], "en", "s", 1), (None, plain[2], None, None, None)]
    df = docs(spark, rows).withColumn("kept", F.lit("clash"))
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 100 not in ids and 101 not in ids and ids.count(1) == 2 and set(range(60)) <= set(ids)
    assert quality.keep_good(df.limit(0)).count() == 0


def plain_verdicts(rows):
    """(measures, verdict) of (text, lang) rows: bands by plain quartiles over each language's texts."""
    pieces, is_byte, multi, single = quality.load_vocabularies(*quality.default_vocabularies())
    found = []
    for text, lang in rows:
        text = text or ""
        n_words, *_, repeated = naive_base(text)
        ids, other = pieces.encode(text), multi.encode_ordinary(text)
        share = [ids.count(i) / len(ids) for i in set(ids)]
        m = {
            "chars_per_token": len(text) / len(ids), "byte_share": sum(bool(is_byte[i]) for i in ids) / len(ids), "entropy": -sum(p * np.log2(p) for p in share),
            "multi_chars_per_token": len(text) / len(other), "multi_byte_share": sum(bool(single[i]) for i in other) / len(other),
        } if ids else {}
        found.append((m, n_words < 50 or 100 * repeated > 50 * n_words, lang or "script " + quality.script(text), len(ids)))
    verdicts = []
    for m, failed, group, n in found:
        kept = not failed
        for c, least in quality.LEAST_SPREAD.items():
            if not kept:
                break
            held = sorted(round(o[c], 3) for o, f, g, _ in found if g == group and not f)
            low, high = held[-(-len(held) // 4) - 1], held[-(-3 * len(held) // 4) - 1]
            far = max(high - low, least) * quality.REACH * (1 + quality.SHORT / max(1, n)) ** 0.5
            kept = not ("below" in quality.SIDES[c] and m[c] < low - far or "above" in quality.SIDES[c] and m[c] > high + far)
        verdicts.append((m, kept))
    return verdicts


def test_quality_verdicts_against_a_plain_version(spark):
    rng = np.random.default_rng(31)
    english, german = "the of water house went under many people found little north garden stone light".split(), "der die das und nicht straße über mädchen größe wasser haus".split()
    junk = lambda: " ".join("".join(map(chr, rng.integers(0x21, 0x7E, 8))) for _ in range(70))
    rows = [(" ".join(rng.choice(english, rng.integers(40, 160))), "en") for _ in range(50)] + [(" ".join(rng.choice(german, rng.integers(55, 120))), "de") for _ in range(30)]
    rows += [(junk(), "en") for _ in range(6)] + [(junk() + " ж中é" * 30, "de"), ("the " * 90, "en"), (None, "en"), ("", None)]
    rows += [(" ".join(rng.choice(["вода", "дом", "большой", "люди", "камень", "свет"], 70)), None) for _ in range(12)] + [(" ".join(rng.choice(english, 30_000)), "en"), rows[0], rows[0]]
    df = docs(spark, [(None if i == 3 else i, t, lang) for i, (t, lang) in enumerate(rows)])
    for clash in ("kept", "entropy", "n_words", "script"):
        df = df.withColumn(clash, F.lit("clash"))
    got = {-1 if r["doc_id"] is None else r["doc_id"]: r for r in quality.rules(df).collect()}
    want = plain_verdicts(rows)
    assert {k for _, k in want} == {True, False} and sum(not k for _, k in want[:86]) >= 6
    for i, (measures, kept) in enumerate(want):
        r = got[-1 if i == 3 else i]
        assert r["kept"] == kept, (i, rows[i][0][:60], measures)
        for c, value in measures.items():
            assert r[c] == pytest.approx(value, abs=1e-9)


# ---- licenses --------------------------------------------------------------------------------------


def naive_license(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(licenses.WORD, low)
    places, labels, best = [], set(), 0.0
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    base = sorted(labels)
    for paragraph in re.split(r"\n[ \t\r\f\n]*\n", low):
        inside = re.findall(licenses.WORD, paragraph)
        held = [set(re.findall(licenses.WORD, line)) for line in paragraph.split("\n")]
        for label, template in licenses.TEMPLATES:
            listed = re.findall(licenses.WORD, template.lower())
            t, span = set(listed), -(-len(listed) * 10 // 9)
            if len(t & set(inside)) < licenses.CONTAINMENT * len(t) - 1e-9:
                continue
            for words_there in held + [set(inside[i : i + span]) for i in range(len(inside))]:
                if len(t & words_there) >= licenses.CONTAINMENT * len(t) - 1e-9:
                    labels.add(label)
                    best = max(best, len(t & words_there) / len(t))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted(labels)), max(best, 1.0 if base else 0.0)


def test_licenses_against_brute_force(spark):
    rng = np.random.default_rng(2)
    pool = [w for _, t in licenses.TEMPLATES for w in t.split()] + ["MIT", "License", "APACHE", "General", "Public", "é", "İ", "K", "x1"]
    texts = ["".join(w + s for w, s in zip(rng.choice(pool, 60), rng.choice([" ", ", ", "\n", "-", "  "], 60, p=[0.7, 0.1, 0.05, 0.1, 0.05]))) for _ in range(60)]
    texts += [None, "", "mit license mit license", "the MIT\nLicense.", "submit license", licenses.TEMPLATES[3][1]]
    texts += ["\n".join(textwrap.wrap(t, 30)) + "\n\n" + " ".join(rng.permutation(t.split())) for _, t in licenses.TEMPLATES]
    texts += [f"a b c {t.upper()} d" for _, t in licenses.TEMPLATES] + ["word " * 5000 + licenses.TEMPLATES[0][1]]
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(docs(spark, [(i, t) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(naive_license(t)), t
    twice = docs(spark, [(1, "MIT License"), (1, "MIT License"), (None, "MIT License")])
    for clash in ("key", "words", "label", "block", "base", "p0"):
        twice = twice.withColumn(clash, F.lit("clash"))
    assert [r["labels"] for r in licenses.scan(twice).collect()] == ["mit"] * 3
    assert licenses.scan(twice.limit(0)).count() == 0


def test_license_phrases_of_a_long_text_in_linear_time(spark):
    import time

    text = "the MIT license, an Apache License and the general public license. " * 30_000
    began = time.perf_counter()
    r = licenses.scan(docs(spark, [(1, text)])).first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (330_000, 90_000, 1, 330_000 - 3, "apache,gpl,mit")
    assert time.perf_counter() - began < 120


def test_license_sql_sees_wrapped_notices_too(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(8)
    texts = ["\n".join(textwrap.wrap(f"Some words. {t} More words.", 35)) for _, t in licenses.TEMPLATES] + [None, "", "MIT License", "x\n\n" + " ".join(rng.permutation(licenses.TEMPLATES[1][1].split()))]
    df = docs(spark, list(enumerate(texts)))
    df.write.parquet(f"{tmp_path}/d.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/d.parquet/*.parquet')")
    want = con.execute(licenses.oracle()).df().sort_values("doc_id").astype(object).where(lambda x: x.notna(), None)
    got = licenses.scan(df).orderBy("doc_id").collect()
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert [tuple(r[c] for c in columns) for r in got] == [pytest.approx(tuple(r)) for r in want[list(columns)].itertuples(index=False)]
    assert all(label in got[i]["labels"].split(",") for i, (label, _) in enumerate(licenses.TEMPLATES))


def test_wrapped_license_notices(spark):
    wrap = lambda t, prefix: "\n".join(textwrap.wrap("Here follows what holds for it. " + t, 40, initial_indent=prefix, subsequent_indent=prefix))
    texts = [wrap(t, p) for _, t in licenses.TEMPLATES for p in ("", " * ", "# ")]
    bsd = next(t for label, t in licenses.TEMPLATES if label == "bsd").split()
    # Nothing to find: half a notice, the other half in another paragraph, or far behind.
    far = "\n".join(["other words of this line"] * 12)
    none = ["\n \n".join([" ".join(bsd[:10]), " ".join(bsd[10:])]), "\n".join([" ".join(bsd[:10]), far, " ".join(bsd[10:])]), " ".join(bsd[:10])]
    got = [r["labels"].split(",") for r in licenses.scan(docs(spark, [(i, t) for i, t in enumerate(texts + none)])).orderBy("doc_id").collect()]
    assert all(label in got[3 * i + k] for i, (label, _) in enumerate(licenses.TEMPLATES) for k in range(3))
    assert got[len(texts) :] == [[""]] * 3


# ---- languages -------------------------------------------------------------------------------------


def test_language_accuracy_on_held_out_documents(spark):
    got = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    held = got.where("held_out").select((F.col("lang") == F.col("lang_pred")).alias("ok"), "score").collect()
    assert len(held) > 100 and sum(r["ok"] for r in held) / len(held) > 0.98 and all(0 <= r["score"] <= 1 for r in held)


def test_language_edges(spark):
    rows = [(i, "der die das und nicht " * 20 if i % 2 else "the and of to in that " * 20, "de" if i % 2 else "en") for i in range(30)]
    rows += [(100, None, "de"), (101, "12 !?", "en"), (102, "the and of", None)]
    df = docs(spark, rows)
    model = langid.train(df)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, model, ["doc_id"]).collect()}
    assert got[100] == got[101] == ("und", 0.0) and got[102][0] == "en" and got[1][0] == "de"
    empty = langid.train(df.limit(0))
    assert langid.identify(df, empty, ["doc_id"]).where("lang_pred != 'und'").count() == 0
    assert langid.identify(df.limit(0), model, ["doc_id"]).count() == 0


def test_ngrams_against_plain_counting():
    from collections import Counter

    rng = np.random.default_rng(6)
    for _ in range(60):
        text = "".join(rng.choice(list("abcÄß .,1\u0301\n"), rng.integers(0, 120)))
        # Words are runs of letters; a space stands between them and at either end.
        line = " " + "".join(c.lower() if c.isalpha() else "." for c in text)
        line = re.sub(r"\.+", " ", line) + " "
        runs = [line[i : i + n] for n in (2, 3, 4) for i in range(len(line) - n + 1) if " " not in line[i + 1 : i + n - 1] and line[i : i + n] != "  "]
        whole = langid.grams(text)
        assert len(whole) == len(runs) and sorted(Counter(whole.tolist()).values()) == sorted(Counter(runs).values())
        for part in (1, 2, 3, 5, 50):  # the same n-grams wherever the parts end
            assert sorted(np.concatenate(list(langid.gram_parts(text, part))).tolist()) == sorted(whole.tolist())


def test_language_of_long_texts_ties_repeats_and_clashes(spark):
    rng = np.random.default_rng(3)
    own = {"de": "der die das und nicht ist".split(), "en": "the and of to in that".split()}
    rows = [(i, " ".join(rng.choice(own[lang], 60)), lang) for i, lang in enumerate(["de", "en"] * 20)]
    model = langid.train(docs(spark, rows).withColumn("gram", F.lit("clash")).withColumn("docs", F.lit(1)))
    rates = model.false_rates()
    long = " ".join(rng.choice(own["de"], 200_000)) + " " + " ".join(rng.choice(own["en"], 100_000))
    counts = lambda parts: sum(len(p) for p in parts)
    assert len(long) > 3 * langid.PART and counts(langid.gram_parts(long)) == counts(langid.gram_parts(long, 1 << 30))
    assert model.predict(long, rates)[0] == "de"
    same = langid.Model.build({"b": langid.grams("abc abd"), "a": langid.grams("abc abd")})
    assert same.predict("abc", same.false_rates())[0] == "a"
    df = docs(spark, [(1, long, "en"), (2, "the and", None), (2, "the and", None), (None, "und nicht", "x")]).withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit("clash"))
    got = sorted(((r["doc_id"] or 0, r["lang_pred"]) for r in langid.identify(df, model, ["doc_id"]).collect()))
    assert got == [(0, "de"), (1, "de"), (2, "en"), (2, "en")]


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(12)
    letters = np.array([chr(c) for c in range(0x4E00, 0x9F00)])
    own = {f"l{k:02}": ["".join(rng.choice(letters[k * 200 : (k + 1) * 200], 5)) for _ in range(40)] for k in range(70)}
    # 68 languages of four rows; one of two rows, one of a single row.
    few = {"l68": 2, "l69": 1}
    rows = [(lang, " ".join(rng.choice(v, 40))) for lang, v in own.items() for _ in range(few.get(lang, 4))]
    model = langid.train(docs(spark, [(i, t, lang) for i, (lang, t) in enumerate(rows)]))
    assert model.languages == sorted(own) and len(model.more) == 1
    asked = {lang: " ".join(rng.choice(v, 40)) for lang, v in own.items()}
    rates = model.false_rates()
    assert {lang: model.predict(t, rates)[0] for lang, t in asked.items()} == {lang: lang for lang in own}


def test_a_language_keeps_so_many_ngrams_and_no_more(spark, monkeypatch):
    rng = np.random.default_rng(13)
    letters = np.array([chr(c) for c in range(0x4E00, 0x9F00)])
    # Long texts, whose n-grams all tie; common words in every text.
    rows = [("zh", " ".join(["the and of"] + ["".join(rng.choice(letters, 6)) for _ in range(400)])) for _ in range(4)] + [("en", "the and of to in that")] * 4
    seen = []
    monkeypatch.setattr(langid.Model, "build", classmethod(lambda cls, held: seen.append(held) or cls(sorted(held), np.zeros(langid.POSITIONS, np.uint64))))
    counts = Counter(g for lang, t in rows if lang == "zh" for g in np.unique(langid.grams(t)).view(np.int64).tolist())
    most = max(counts.values())
    ranked = sorted(counts, key=lambda g: (-counts[g], g))
    for grams, least in ((10, 1), (len([g for g in counts if counts[g] == most]), 1), (1000, 1), (10**6, 1)):
        monkeypatch.setattr(langid, "GRAMS", grams)
        monkeypatch.setattr(langid, "LEAST_DOCS", least)
        langid.train(docs(spark, [(i, t, lang) for i, (lang, t) in enumerate(rows)]))
        assert sorted(seen[-1]["zh"].view(np.int64).tolist()) == sorted(ranked[:grams])


def test_verdicts_against_a_plain_version():
    rng = np.random.default_rng(14)
    own = {"a": "ab abc abd ba".split(), "b": "ba bac bad ab".split(), "c": "xy xyz yx".split()}
    model = langid.Model.build({lang: np.unique(langid.grams(" ".join(v))) for lang, v in own.items()})
    rates = model.false_rates()
    for _ in range(200):
        text = " ".join(rng.choice(own["a"] + own["b"] + own["c"] + ["qq"], rng.integers(1, 9)))
        hashes, share = langid.grams(text).tolist(), []
        for i, lang in enumerate(model.languages):
            held = [all(int(model.masks[int(p[0])]) >> i & 1 for p in langid._probes(np.array([h], np.uint64))) for h in hashes]
            share.append(min(1.0, max(0.0, (sum(held) / len(hashes) - rates[i]) / (1 - rates[i]))))
        best = share.index(max(share))
        assert model.predict(text, rates) == (model.languages[best], pytest.approx(share[best]))


def test_filter_finds_all_it_holds_and_few_others():
    rng = np.random.default_rng(0)
    held = {k: rng.integers(0, 2**63, 20_000).astype(np.uint64) for k in ("a", "b")}
    model = langid.Model.build(held)
    masks = np.full(20_000, ~np.uint64(0))
    for p in langid._probes(held["a"]):
        masks &= model.masks[p]
    assert (masks & np.uint64(1)).all() and np.mean(masks & np.uint64(2) > 0) < 0.01


# ---- personal data ---------------------------------------------------------------------------------


def naive_pii(text):
    found = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    found["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    found["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


def test_pii_base_against_the_plain_patterns():
    rng = np.random.default_rng(7)
    for alphabet, n in (("a1.@- ", 400), ("0123456789. ", 400), ("0123456789 -+().", 500), ("a@b.é", 300)):
        for _ in range(60):
            text = "".join(rng.choice(list(alphabet), n))
            got = pii.spans(text)
            assert {k: got[k] for k in pii.BASE_KINDS} == naive_pii(text), text


def test_pii_checksums_scores_and_masks(spark):
    text = "write to jo@mail.com, card 4111 1111 1111 1111, IBAN GB82 WEST 1234 5698 7654 32 IS mine, +1 (212) 555-0100, 10.0.0.1"
    kinds = {k: [text[s:e] for s, e in v] for k, v in pii.spans(text).items()}
    assert kinds["iban"] == ["GB82 WEST 1234 5698 7654 32"] and kinds["card"] == ["4111 1111 1111 1111"]
    assert pii.score(text, "email", *pii.spans(text)["email"][0]) > pii.PRIOR["email"]
    df = docs(spark, [(1, text, "en", "s", 99), (2, None, "en", "s", None), (3, "", "en", "s", 0), (3, "", "en", "s", 0)]).withColumn("pii", F.lit(5))
    out = pii.mask(df)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == df.columns and out.count() == 4
    assert rows[1]["text"] == "write to [EMAIL], card [CARD], IBAN [IBAN] IS mine, [PHONE], [IP]" and rows[1]["n_chars"] == len(rows[1]["text"])
    assert rows[2]["text"] is None and rows[2]["n_chars"] is None
    digest = {r["doc_id"]: r for r in pii.digest(df).collect()}
    assert digest[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and digest[1]["n_card"] == 1
    assert len(pii.detect(df.select("doc_id", "text"), ["doc_id"]).where("doc_id = 1").first()["pii"]) == 5


def test_pii_context_decides_what_could_be_anything(spark):
    accepted = {
        "her SSN is 123-45-6789.": ("ssn", "123-45-6789"),
        "call (020) 7946 0018 today": ("local_phone", "(020) 7946 0018"),
        "she was born on 14 May 1987 in Ulm": ("birth_date", "14 May 1987"),
        "date of birth: 1987-05-14": ("birth_date", "1987-05-14"),
        "passport C1234567": ("document_id", "C1234567"),
    }
    refused = ["part 123-45-6789", "a sum of 020 7946 0018", "published on 14 May 1987", "code C1234567", "SSN 000-45-6789", "SSN 1123-45-6789", "born 1200-05-14", "phone version 1.555.1234.99", "call serial 555-1234", "passport C1111111"]
    for text, (kind, value) in accepted.items():
        found = pii.spans(text)
        assert {k: [text[s:e] for s, e in v] for k, v in found.items() if v} == {kind: [value]}, text
        assert pii.score(text, kind, *found[kind][0]) >= pii.ACCEPT
    for text in refused:
        assert not any(pii.spans(text).values()), text
    # A confirmed span is not told twice.
    text = "phone +1 (212) 555-0100"
    assert {k for k, v in pii.spans(text).items() if v} == {"phone"}
    rows = [(1, "her SSN is 123-45-6789, IP 10.0.0.1", "en"), (None, None, "en"), (2, "", "en"), (2, "", "en")]
    df = docs(spark, rows)
    for clash in ("spans", "score", "pii", "kind"):
        df = df.withColumn(clash, F.lit("clash"))
    got = pii.digest(df).orderBy(F.desc_nulls_last("n_ip"), "doc_id").collect()
    assert (got[0]["spans"], got[0]["scores"]) == ("ip:27:35,ssn:11:22", f"0.8,{got[0]['scores'].split(',')[1]}") and len(got) == 4 and got[1]["score"] is None
    assert pii.digest(df.limit(0)).count() == 0 and pii.mask(df).where("doc_id = 1").first()["text"] == "her SSN is [SSN], IP [IP]"


def test_pii_is_linear_in_long_runs():
    for text in ("born 12-34-" * 60_000, "call 12 345 " * 60_000, "a" * 300_000 + " @", "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000):
        pii.spans(text)


def test_oracles_belong_to_queries():
    assert set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) == 10
