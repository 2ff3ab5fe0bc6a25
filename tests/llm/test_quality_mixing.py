"""Quality rules, quality classifier and mixing against plain Python, and the pipeline as a whole."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.llm import mixing, quality_classifier, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def base(text):
    words = WORD.findall(text)
    found = Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if found[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(inside)


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(60, 200)), "en" if i % 3 else "de") for i in range(400)]
    rows += [(1000 + i, " ".join(w + "%%%$$$" for w in prose(rng, 90).split()), "en") for i in range(10)]
    rows += [(2000 + i, " ".join(["same"] * 100), "en") for i in range(5)]
    rows += [(3000, None, "en"), (3001, "", None), (3002, " \n\t", "xx"), (3003, "a b\na b\n\na b c d \x0b e", None), (0, rows[0][1], "de"), (3004, "日本語 " * 60, "ja"), (None, prose(rng, 70), "en")]
    rows += [(3005, prose(rng, 20000), "en")]
    return rows


def test_counts_and_verdicts(spark, documents):
    frame = spark.createDataFrame([(*r, 7) for r in documents], "doc_id long, text string, lang string, kept_ int").repartition(3)
    found = quality_rules.judge(frame.withColumn("raw", F.col("text"))).collect()
    assert len(found) == len(documents)
    for r in found:
        counts = base(r["raw"] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts, repr(r["raw"])
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r["kept"] and r["base_failed"])
        assert (r["log_perplexity"] is None) == (counts[0] == 0)
    kept = {r["doc_id"] for r in found if r["kept"]}
    assert set(range(400)) <= kept and 3005 in kept
    assert not kept & set(range(1000, 1010)) and not kept & set(range(2000, 2005))
    assert quality_rules.judge(frame.limit(0)).collect() == []


def kneser_ney(counts):
    """Probability of a gram's last character, from top-order counts, by the textbook."""
    orders = {4: {g: n for g, n in counts.items() if len(g) == 4}}
    for n in (3, 2, 1):
        table = Counter(g[1:] for g in orders[n + 1])
        for g, c in counts.items():
            if len(g) == n:
                table[g] += c
        orders[n] = dict(table)
    steps, totals = {}, {}
    for n, table in orders.items():
        c = Counter(table.values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + 2 * c[2] else None
        values = []
        for i in (1, 2, 3):
            d = i - (i + 1) * y * c[i + 1] / c[i] if y is not None and c[i] else None
            values.append(d if d is not None and 0 < d < i else 0.5 * i)
        steps[n] = values
        totals[n] = defaultdict(float)
        for g, k in table.items():
            totals[n][g[:-1]] += k
    held = {n: {g: k - steps[n][min(k, 3) - 1] for g, k in table.items()} for n, table in orders.items()}
    kept = {n: defaultdict(float) for n in orders}
    for n, table in held.items():
        for g, h in table.items():
            kept[n][g[:-1]] += h

    def p(gram):
        if not gram:
            return 1 / (len(orders[1]) + 1)
        n, context = len(gram), gram[:-1]
        if context not in totals[n]:
            return p(gram[1:])
        back = 1 - kept[n][context] / totals[n][context]
        return held[n].get(gram, 0.0) / totals[n][context] + back * p(gram[1:])

    return p


def test_model_equals_the_textbook(spark):
    rng = random.Random(2)
    texts = [prose(rng, 120) for _ in range(30)]
    frame = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(4)
    model = quality_rules.fit(frame)
    counts = Counter()
    for t in texts:
        for w in t.split():
            s = f" {w} "
            for i in range(1, len(s)):
                counts[s[max(0, i - 3) : i + 1]] += 1
    p = kneser_ney(counts)
    for gram in [*list(counts)[:300], "qzxy", " zz", "theq", "x"]:
        assert math.isclose(model.character("en", gram), math.log(p(gram)), rel_tol=1e-4, abs_tol=1e-4), gram
    # Probabilities of all characters after a context add up to one, unknown ones included.
    alphabet = {g[-1] for g in counts}
    total = sum(math.exp(model.character("en", "the"[:3] + c)) for c in alphabet)
    assert 0.98 < total <= 1.0001
    assert model.total("en", [b"there", b"there"]) == pytest.approx(2 * model.word("en", b"there"))


def test_pruned_models_stay_within_their_bound(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "MAX_ENTRIES", 600)
    rng = random.Random(3)
    frame = spark.createDataFrame([(prose(rng, 200), "en") for _ in range(40)], "text string, lang string")
    model = quality_rules.fit(frame)
    assert len(model.keys) < 1200
    assert -12 < model.character("en", " the") < 0


@pytest.mark.parametrize("most", [1, 600])
def test_entries_beyond_the_bound_count_as_those_within_it(spark, monkeypatch, documents, most):
    rng = random.Random(6)
    odd = [(5000 + i, " ".join("".join(chr(rng.randint(0x400, 0x4FF)) for _ in range(4)) + rng.choice(["", "#&|$"]) for _ in range(80)), rng.choice(["en", None])) for i in range(20)]
    frame = spark.createDataFrame(documents[:60] + documents[400:-1] + odd, "doc_id long, text string, lang string").repartition(3)
    columns = ["doc_id", "lang", "n_words", "n_repeat_words", "base_failed", "kept"]

    def judged():
        rows = quality_rules.judge(frame.withColumn("raw", F.col("text"))).collect()
        return sorted(((str([r[c] for c in columns]), r["raw"] or "", r["log_perplexity"]) for r in rows), key=lambda r: r[:2])

    whole = judged()
    monkeypatch.setattr(quality_rules, "MAX_ENTRIES", most)
    assert len(quality_rules.fit(frame).keys) <= most
    bounded = judged()
    assert [r[:2] for r in bounded] == [r[:2] for r in whole]
    for (_, _, a), (_, _, b) in zip(bounded, whole, strict=True):
        assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9))


def test_a_text_with_a_long_word_does_not_copy_the_memo():
    class Memo(dict):
        def __or__(self, other):
            raise AssertionError("copied")

    none = np.array([], dtype=np.int64), np.array([], dtype=np.float32)
    model = quality_rules.Model(*none, *none, {"en": 30})
    model.words["en"] = Memo()
    long = b"x" * 100
    # 1 + 3 + 101 characters to predict, each as likely as any of 31; a long word is not remembered.
    for _ in range(2):
        assert model.total("en", [b"a", b"bc", long]) == pytest.approx(-(2 + 3 + 101) * math.log(31))
    assert set(model.words["en"]) == {b"a", b"bc"}
    assert quality_rules.pieces(" ab ") == [" a", " ab", " ab "] and quality_rules.pieces("  ") == ["  "]


def test_a_language_keeps_its_words_where_the_others_fill_the_memo(monkeypatch):
    monkeypatch.setattr(quality_rules, "MEMO_WORDS", 10)
    monkeypatch.setattr(quality_rules, "MEMO_VALUES", 10, raising=False)
    none = np.array([], dtype=np.int64), np.array([], dtype=np.float32)
    model, asked = quality_rules.Model(*none, *none, {"en": 30, "de": 30}), []
    plain = model.word
    monkeypatch.setattr(model, "word", lambda lang, word: asked.append((lang, word)) or plain(lang, word))
    model.total("en", [b"w%d" % i for i in range(12)])
    for word in (b"b", b"c", b"d"):
        assert model.total("de", [b"a", word, b"a"]) == pytest.approx(-6 * math.log(31))
    assert asked.count(("de", b"a")) == 1


def test_language_of_symbols_alone_has_a_model(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 120), "en") for i in range(100)]
    rows += [(1000 + i, " ".join(f"{rng.choice('abcxyz')}|{rng.choice(SYLLABLES)}&" for _ in range(90)), "code") for i in range(120)]
    rows += [(2000 + i, " ".join("".join(chr(rng.randint(0x400, 0x9FF)) for _ in range(6)) + "<>" for _ in range(90)), "code") for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = {r["doc_id"]: r for r in quality_rules.judge(frame).collect()}
    assert len({found[1000 + i]["log_perplexity"] for i in range(120)}) > 100
    assert all(found[1000 + i]["kept"] for i in range(120)) and not any(found[2000 + i]["kept"] for i in range(3))


def test_small_languages_have_a_band_of_their_own(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, 120), "en") for i in range(150)]
    signs = [chr(0x4E00 + i) for i in range(3000)]
    rows += [(1000 + i, " ".join("".join(rng.choice(signs) for _ in range(2)) for _ in range(80)), "zh" if i % 2 else None) for i in range(24)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = {r["doc_id"] for r in quality_rules.judge(frame).collect() if r["kept"]}
    assert kept == {r[0] for r in rows}


def test_bands_do_not_jump_with_the_size_of_a_language(spark):
    values = [("big", 1.5)] * 1000 + [("a", 3.0)] * 99 + [("b", 3.0)] * 100 + [("c", 3.0)]
    found = {r["lang"]: r for r in quality_rules.bands(spark.createDataFrame(values, "__lang string, log_perplexity double"), 1.0, 1.0).collect()}
    assert abs(found["a"]["low"] - found["b"]["low"]) < 0.01
    assert 1.5 < found["c"]["low"] < found["a"]["low"] <= 3.0 and found["big"]["low"] == pytest.approx(1.5, abs=0.002)


def test_classifier_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(4)
    rows, truth = [], {}
    for i in range(3000):
        good = rng.random() < 0.8
        text = prose(rng, rng.randint(20, 120))
        if not good:
            text = " ".join(w + rng.choice(["***", "%%%"]) for w in text.split()) if rng.random() < 0.5 else " ".join([rng.choice(SYLLABLES)] * 80)
        rows.append((i, text, "kept"))
        truth[i] = int(good)
    rows += [(5000, None, "a"), (5001, "", "b"), (None, prose(rng, 40), "c"), (7, rows[7][1], "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string").repartition(4)
    labels = spark.createDataFrame([(i, t, 0) for i, t in truth.items() if i % 2] + [(None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    model, described = quality_classifier.fit(docs, labels)
    scores = {r["id"]: r["score"] for r in model.score_described(described).collect()}
    assert described.count() == len(rows) and all(0 <= s <= 1 for s in scores.values())
    right = np.mean([(scores[i] >= quality_classifier.LIMIT) == bool(t) for i, t in truth.items()])
    assert right > 0.95 and 0.7 < model.prior < 0.9
    same = {r["doc_id"]: r["score"] for r in model.score(docs).where("x = 'kept'").collect()}
    assert all(math.isclose(same[i], scores[i], rel_tol=1e-9) for i in same)
    kept = quality_classifier.filter_documents(docs, labels)
    assert kept.columns == docs.columns
    assert kept.where("doc_id < 3000").count() >= 0.9 * sum(truth.values())


def test_held_out_labels_are_not_used(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, prose(rng, 40)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    spoilt = labels.withColumn("quality", F.when(quality_classifier.held_out(), 0).otherwise(F.col("quality")))
    first, _ = quality_classifier.fit(docs, labels)
    second, _ = quality_classifier.fit(docs, spoilt)
    assert np.allclose(first.weights, second.weights) and first.prior == second.prior


def test_classifier_without_rows_or_labels(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.filter_documents(docs.limit(0), none).collect() == []
    model, described = quality_classifier.fit(docs, none)
    assert model.score_described(described).first()["score"] == 0.5


def mix_by_hand(rows, repetition):
    """Copies of each row, from sorted lists; places come from the operator's hash."""
    tokens, docs = Counter(), defaultdict(Counter)
    for source, place, n in rows:
        tokens[source] += n
        docs[source][place] += n
    used = {s: n for s, n in tokens.items() if n}
    least, most = min(used.values()), max(used.values())
    exponent = 0.0 if most / least <= repetition else 1 - math.log(repetition) / math.log(most / least)
    wanted = {s: n * (most / n) ** (1 - exponent) for s, n in used.items()}
    out = []
    for source, place, _ in rows:
        if not tokens[source]:
            out.append(1)
            continue
        passes, rest = divmod(round(wanted[source]), tokens[source])
        upto, last = 0, -1
        for p, n in sorted(docs[source].items()):
            upto += n
            if upto > rest:
                break
            last = p
        out.append(passes + (rest > 0 and place <= last))
    return out


def test_mixing_equals_sorted_lists(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["hot"] * 12 + ["a", "b", "b", None]), rng.choice([0, 1, 5, 40, 300])) for i in range(3000)]
    rows += [(9000, "empty", 0), (None, "a", 3), (5, rows[5][1], rows[5][2])]
    frame = spark.createDataFrame(rows, "doc_id long, source string, t long").withColumn("text", F.lit("x")).repartition(5)
    target = mixing.Target(repetition=3.0)
    mixed = mixing.mix(frame, target, tokens=F.col("t")).withColumn("place", mixing.place(F.col("doc_id"), F.col("source"), mixing.SEED)).collect()
    assert len(mixed) == len(rows)
    expected = mix_by_hand([(r["source"], r["place"], r["t"]) for r in mixed], 3.0)
    wrong = sum(r["copies"] != e for r, e in zip(mixed, expected, strict=True))
    assert wrong <= 3  # a rounded token at the end of a part
    assert min(r["copies"] for r in mixed) >= 1 and max(r["copies"] for r in mixed) <= 4
    assert mixing.repeat(mixing.mix(frame, target, tokens=F.col("t"))).count() == sum(r["copies"] for r in mixed)


def test_mixing_meets_entropy_and_budget(spark):
    rows = [(i, "abcd"[min(i % 16, 3)], 10) for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, t long")
    sources = mixing.totals(frame, "source", F.col("t"))
    exponent, normaliser, budget = mixing.fit_exponent(sources, mixing.Target(repetition=1e9, entropy=1.0, budget=10_000))
    shares = {r["source"]: r["tokens"] / 40_000 for r in sources.collect()}
    weights = {s: p**exponent / normaliser for s, p in shares.items()}
    assert math.isclose(sum(weights.values()), 1.0, rel_tol=1e-6) and budget == 10_000
    assert math.isclose(-sum(w * math.log(w) for w in weights.values()), 1.0, abs_tol=1e-5)
    mixed = mixing.mix(frame, mixing.Target(repetition=1e9, entropy=1.0, budget=10_000), tokens=F.col("t"))
    used = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("t")).alias("n")).collect()}
    assert all(abs(used[s] - 10_000 * w) <= 11 for s, w in weights.items())


def test_mixing_of_one_source_and_of_nothing(spark):
    frame = spark.createDataFrame([(1, "a", "x y"), (2, "a", None)], "doc_id long, source string, text string")
    assert [r["copies"] for r in mixing.mix(frame, mixing.Target()).collect()] == [1, 1]
    assert mixing.mix(frame.limit(0), mixing.Target()).collect() == []


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(7)
    rows = []
    for i in range(500):
        text = prose(rng, rng.randint(30, 120))
        if i % 10 == 3:
            text += " token = 0123456789abcdef0123456789abcdef01234567"
        if i % 25 == 9:
            text = " ".join(w + "%%%" for w in text.split())
        rows.append((i, text, "en", "hot" if i % 3 else f"s{i % 5}", len(text)))
    rows += [(1000 + i, rows[i * 7 + 1][1] + (" tail" if i % 2 else ""), "en", "hot", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 25 != 9)) for i in range(0, 500)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        seen.append((docs, docs := spark.read.parquet(path)))
    for before, after in seen[:-1]:
        assert before.columns == after.columns
    ids = [{r["doc_id"] for r in after.select("doc_id").collect()} for _, after in seen]
    good = {i for i, *_ in rows if not (i < 500 and i % 25 == 9)}
    assert len(good & ids[0]) >= 0.95 * len(good)
    words = {r["doc_id"]: r["text"].split() for r in seen[0][1].collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    linked = {b for b in sets if b >= 1000 for a in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert linked and ids[1] == ids[0] - linked
    assert ids[2] == ids[1] == ids[3] == ids[4]
    assert not any("0123456789abcdef" in r["text"] for r in seen[2][1].collect())
    final = seen[4][1]
    assert final.count() == seen[3][1].count() >= seen[2][1].count()
    assert final.where("not exact").count() == 0 and final.agg(F.min("n_tokens")).first()[0] > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == final.count()
