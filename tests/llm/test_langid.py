from pyspark.sql import functions as F

from wayfold.llm import langid


def test_held_out_accuracy(corpus):
    model = langid.fit(corpus.filter(~langid.held_out()), F.col("doc_id"))
    rows = langid.predict(corpus, model).join(corpus.select("doc_id", "lang", langid.held_out().alias("held")), "doc_id").filter("held and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_backoff():
    model = langid.Model([("wthe", ["en"], [5]), ("wle", ["fr"], [5]), ("1t", ["en", "fr"], [4, 1]), ("1l", ["en", "fr"], [1, 4]), ("2th", ["en"], [3])])
    assert model.predict("the") == ("en", model.predict("the")[1]) and model.predict("l" * 100)[0] == "fr" and model.predict("xth")[0] == "en"
    assert model.predict(None) == model.predict("12 !") == ("und", 0.0)


def test_small_cache_gives_the_same(monkeypatch, corpus):
    rows = [r.text for r in corpus.select("text").limit(40).collect()]
    model = langid.fit(corpus, F.col("doc_id"))
    want = [model.predict(t) for t in rows]
    monkeypatch.setattr(langid, "CACHE_ENTRIES", 300)
    langid._forget()
    got = [model.predict(t) for t in rows]
    assert [x for x, _ in got] == [x for x, _ in want]


def test_odd_tables(docs, empty, corpus):
    model = langid.fit(corpus, F.col("doc_id"))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert len(got) == 10 and got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == got[9].lang_pred == "und" and got[4].lang_pred == got[5].lang_pred
    kept = langid.accepted(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.filter("doc_id in (0, 1, 2, 9)").count() == 0
    assert langid.predict(empty, langid.fit(empty, F.col("doc_id"))).count() == 0
    assert langid.predict(docs, langid.fit(empty, F.col("doc_id"))).filter("lang_pred <> 'und'").count() == 0


def test_numbers_are_no_letters():
    assert langid.words_of("½ ² Ⅷ x² Ünï 3d É") == ["x", "ünï", "d", "é"] and langid.words_of("1 ½ ²") == []
    model = langid.Model([("1a", ["en"], [4])])
    assert model.predict("½ ² Ⅷ 12") == ("und", 0.0)


def test_model_and_scores_against_plain_counting(spark):
    """Counts of a small table, and each prediction from them, in plain Python."""
    import math
    from collections import Counter

    rows = [*[("the cat sat on the mat again and again", "en")] * 14, *[("le chat est sur le tapis", "fr")] * 13, ("le chat est sur le tapis encore et encore", "fr"), ("the dog and the cat", "en"), ("x" * 90 + " le chien " + "x" * 90, "fr"), (None, "fr"), ("kein", None)]
    model = langid.fit(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, text string, lang string"), F.col("id"))
    units = {"en": Counter(), "fr": Counter()}
    for text, lang in rows:
        for word in text.split() if text and lang else []:
            units[lang][f"w{word}"] += 1
            for n in range(1, 6):
                marked = f"<{word}>" if n > 1 else word
                units[lang].update(f"{n}{marked[i : i + n]}" for i in range(len(marked) - n + 1))
    known = {u for c in units.values() for u in c if sum(x[u] for x in units.values()) >= (langid.LEAST_WORD if u[0] == "w" else langid.LEAST_GRAM)}
    total = {(lang, kind): sum(n for u, n in c.items() if u in known and u[0] == kind) for lang, c in units.items() for kind in "w12345"}
    log = lambda lang, u: math.log((units[lang][u] + 0.5) / (total[lang, u[0]] + 1))
    assert set(model.row) == known and len(known) > 10
    for text in ("the cat", "le tapis", "again chien", "catx", "x" * 200, "zzz", "the le"):
        sums = []
        for lang in ("en", "fr"):
            s = 0.0
            for word in text.split():
                found = [f"w{word}"] if f"w{word}" in known else []
                for n in range(5, 0, -1):
                    marked = f"<{word}>" if n > 1 else word
                    found = found or [u for i in range(len(marked) - n + 1) if (u := f"{n}{marked[i : i + n]}") in known]
                s += sum(log(lang, u) for u in found) / len(found) if found else 0.0
            sums.append(s)
        lang, score = model.predict(text)
        shares = [math.exp((s - max(sums)) / math.sqrt(len(text.split()))) for s in sums]
        assert lang == ("en", "fr")[sums.index(max(sums))] and abs(score - max(shares) / sum(shares)) < 1e-9
