"""Language model, classifier, language identification and license scans."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.llm import hmm, languages, licenses, quality
from orderlens.llm.common import table
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.01"


# -- hidden Markov model ----------------------------------------------------------------


@pytest.fixture
def small_model(monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK", 4)
    rng = np.random.default_rng(1)
    model = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(6), 3)
    lengths = np.array([1, 4, 5, 13, 9, 2, 8, 12, 3, 17])
    return model, rng.integers(0, 6, lengths.sum()), lengths


def texts_of(obs, lengths):
    return np.split(obs, np.cumsum(lengths)[:-1])


def plain_forward(o, model):
    start, a, b = model
    rows = [start * b[:, o[0]]]
    for x in o[1:]:
        rows.append((rows[-1] @ a) * b[:, x])
    return np.array(rows)


def test_likelihood_is_exact(small_model):
    model, obs, lengths = small_model
    expected = [np.log(plain_forward(o, model)[-1].sum()) for o in texts_of(obs, lengths)]
    assert np.allclose(hmm.log_likelihoods(obs, lengths, model), expected, atol=1e-12)


def test_expected_counts_are_exact(small_model):
    model, obs, lengths = small_model
    start, a, b = model
    first, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 6))
    for o in texts_of(obs, lengths):
        forward = plain_forward(o, model)
        back = [np.ones(3)]
        for x in o[:0:-1]:
            back.append(a @ (b[:, x] * back[-1]))
        back, total = back[::-1], forward[-1].sum()
        first += forward[0] * back[0] / total
        for t, x in enumerate(o):
            emits[:, x] += forward[t] * back[t] / total
            if t + 1 < len(o):
                moves += forward[t][:, None] * a * (b[:, o[t + 1]] * back[t + 1]) / total
    got = hmm.expected(obs, lengths, model)
    for x, y in zip(got, (first, moves, emits)):
        assert np.allclose(x, y, atol=1e-12)


def test_baum_welch_raises_the_likelihood(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").withColumn("held_out", F.lit(False))
    few = [hmm.score_texts(docs, rounds=n).agg(F.sum("score")).first()[0] for n in (0, 1, 4)]
    assert few[0] < few[1] < few[2]


@pytest.mark.parametrize("head", [0, 2, 50])
def test_scores_of_a_table(spark, documents, monkeypatch, head):
    """Every column beside the definition, however few words travel: also the score, with the
    trained states and emissions but everything else counted here."""
    monkeypatch.setattr(hmm, "HEAD", head)  # most words go through the join
    trained, travelled = [], []
    learn, fetch = hmm.baum_welch, hmm.commonest
    monkeypatch.setattr(hmm, "baum_welch", lambda *x: trained.append(learn(*x)) or trained[-1])
    monkeypatch.setattr(hmm, "commonest", lambda *x: travelled.append(fetch(*x)) or travelled[-1])
    # Three words stand more often than texts end, one of them too long to travel.
    few = ["alpha beta gamma " * 3 + "y" * 70 + f" w{k} x{k % 7}" for k in range(60)]
    made = documents([(10_000 + k, t) for k, t in enumerate(few + [None, ""])])
    given = table(spark, SF, "documents").limit(60).select(made.columns)
    docs = made if head == 2 else made.unionByName(given)
    rows = {r.doc_id: r for r in hmm.score_table(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    tokens = {i: (t or "").encode().lower().split() + [b""] for i, t in texts.items()}
    counts = Counter(w for i, t in tokens.items() if not out[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    assert len(travelled[0]) <= head and all(counts[w] == c and 0 < len(w) <= 64 for w, c in travelled[0])
    own = {b"": 0} | {w: k + 1 for k, (w, _) in enumerate(travelled[0])}

    def class_of(word):
        return own.get(word, 2048 + zlib.crc32(word[-3:]) % 2048)

    held, distinct = Counter(), Counter(map(class_of, counts))
    for w, c in counts.items():
        held[class_of(w)] += c
    for i, words in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (out[i], len(words), n)
        assert r.n_known == sum(counts[w] > 0 for w in words)
        base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        start, a, b = trained[0]
        state, logs = None, 0.0
        for w in words:
            k = class_of(w)
            state = (start if state is None else state @ a) * b[:, k]
            logs += np.log10(state.sum()) + np.log10((counts[w] + 1) / (held[k] + distinct[k] + 1))
            state = state / state.sum()
        assert r.score == pytest.approx(logs, abs=1e-6)


def test_model_beats_the_base_on_held_out_texts(spark):
    held = hmm.score_table(table(spark, SF, "documents")).where("held_out").agg(
        F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert held.score > held.base


def test_a_band_that_does_not_fit_is_cut(spark):
    """Equally frequent words travel as far as there is room."""
    flat = spark.createDataFrame([(bytearray(f"w{k}".encode()), 3) for k in range(3000)]
                                 + [(bytearray(b"top"), 90), (bytearray(b""), 500)], "word binary, c long")
    got = hmm.commonest(flat, 1000)
    assert got[0] == (b"top", 90) and 950 <= len(got) <= 1000
    assert len(hmm.commonest(flat, 5000)) == 3001 and hmm.commonest(flat, 0) == []


def test_classes_grow_with_the_vocabulary():
    assert hmm.classes_for(0) == hmm.classes_for(10 ** 6) == 4096
    assert hmm.classes_for(10 ** 8) == 65536 and hmm.class_type(65536) == "<u2"
    assert hmm.classes_for(10 ** 9) == 131072 and hmm.class_type(131072) == "<u4"


def test_model_is_a_distribution_over_words():
    """Class emissions times word shares sum to 1 over the known words and one unknown a class."""
    counts = {w.encode(): k + 1 for k, w in enumerate(sorted(set(prose(1, 200).split())))}
    words = hmm.Words(sorted(counts.items(), key=lambda x: -x[1])[:20])
    mass = Counter()
    sizes, tokens = Counter(), Counter()
    for w, c in counts.items():
        sizes[words.class_of(w)] += 1
        tokens[words.class_of(w)] += c
    for w, c in counts.items():
        k = words.class_of(w)
        mass[k] += (c + 1) / (tokens[k] + sizes[k] + 1)
    assert all(mass[k] + 1 / (tokens[k] + sizes[k] + 1) == pytest.approx(1) for k in mass)


# -- quality ----------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality.quality_table(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_sees_no_held_out_label(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    hidden = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    changed = docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")})
    a = {r.doc_id: r.score for r in quality.quality_table(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.quality_table(changed, hidden).collect()}
    assert a == pytest.approx(b)


def test_negative_risk_is_held_at_zero():
    rng = np.random.default_rng(0)
    positive = rng.normal(1, 1, (200, 3)).astype(np.float32)
    unlabelled = np.concatenate([rng.normal(1, 1, (300, 3)), rng.normal(-3, 1, (100, 3))]).astype(np.float32)
    weights, intercept = quality.fit(positive, unlabelled, 0.75)
    assert np.isfinite(weights).all()
    assert (positive @ weights + intercept > 0).mean() > 0.95
    assert (unlabelled[300:] @ weights + intercept < 0).mean() > 0.95


# -- languages --------------------------------------------------------------------------


def test_languages_of_held_out_documents(spark):
    docs = table(spark, SF, "documents")
    rows = languages.language_table(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)


def test_mixture_proportions(spark):
    docs = table(spark, SF, "documents")
    known = {r.lang: r.text for r in docs.where("length(text) > 1500").dropDuplicates(["lang"]).collect()}
    langs, logs = languages.train(docs)
    half = lambda lang: " ".join(known[lang].split()[:150])
    mixed = f"{half('en')} {half('de')}".encode()
    theta = languages.infer([mixed, half("fr").encode(), b"", b"123"], logs)
    share = dict(zip(langs, theta[0]))
    assert set(np.array(langs)[theta[0] > 0]) == {"de", "en"} and 0.25 < share["en"] < 0.75
    assert theta[1].argmax() == langs.index("fr") and (theta[1] > 0).sum() == 1
    assert not theta[2:].any()


def test_texts_without_letters(documents):
    docs = documents([(0, "abc def", "x"), (1, "123 !!", "x"), (2, None, "y"), (3, "ñ", "x"), (4, "abc", "x")])
    got = {r.doc_id: (r.lang_pred, r.score) for r in languages.language_table(docs).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[0][0] == got[4][0] == "x"


# -- licenses ---------------------------------------------------------------------------


def plain_scan(text):
    words = bytes(text or "", "utf8").translate(licenses.SPLIT).split()
    places = []
    for phrase, label in licenses.PHRASES.items():
        part = phrase.encode().split()
        places += [(k, label) for k in range(len(words)) if words[k:k + len(part)] == part]
    starts = [k for k, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


def test_phrases_match_brute_force(documents):
    texts = [None, "", "Under the MIT License", "under the mit-license, under the mit license",
             "apache license version 2.0", "CC BY-NC under the mit under the mit license cc by nc",
             "mit license", "ünder the mit license under_the_mit_license", prose(1, 50)]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
           for r in licenses.scan_licenses(documents(list(enumerate(texts)))).collect()}
    assert got == {k: plain_scan(t) for k, t in enumerate(texts)}


def test_notices_are_found_with_small_edits(documents):
    mit = next(text for label, text, _ in licenses.NOTICES if label == "mit")
    gpl = next(text for label, text, _ in licenses.NOTICES if label == "gpl")
    edited = gpl.replace("you can", "and you may freely")
    texts = [prose(2, 30) + " " + mit + " " + prose(3, 30), edited, mit.replace("hereby granted", "given"),
             "gnu general public license", prose(4, 60)]
    got = [r.labels for r in sorted(licenses.scan_licenses(
        documents(list(enumerate(texts)))).collect(), key=lambda r: r.doc_id)]
    assert got == ["mit", "gpl", "", "", ""]


def test_all_notices_of_one_file_are_found(documents):
    notices = [text for _, text, _ in licenses.NOTICES]
    mit = notices[0].replace("obtaining a copy", "obtaining the copy")
    words = sorted({w for text in notices for w in text.split()})
    texts = [" ".join(notices), " and then ".join(reversed(notices)),
             prose(5, 20) + " " + notices[3] + " " + " ".join(words),
             " ".join(words) + " " + prose(6, 20) + " " + mit, " ".join(words)]
    got = [r.labels for r in sorted(licenses.scan_licenses(
        documents(list(enumerate(texts)))).collect(), key=lambda r: r.doc_id)]
    every = ",".join(sorted(label for label, *_ in licenses.NOTICES))
    assert got == [every, every, "gpl", "mit", ""]


def test_a_notice_counts_in_any_surroundings():
    index = licenses.Index(licenses.templates(), 0, {})
    every = sorted({w for t in index.known for w in t.words})
    for k, t in enumerate(index.known):
        if not t.base:
            # Only the mandatory phrases and what makes up the least share: other words replaced.
            kept = {p for at, part in t.mandatory for p in range(at, at + len(part))}
            for p in range(len(t.words)):
                if len(kept) < index.least * len(t.words):
                    kept.add(p)
            words = [w if p in kept else b"other" for p, w in enumerate(t.words)]
            for around in ([], every):
                assert k in {f[0] for f in index.scan(words + [b"other"] * 9 + around)[1]}, t.label
