"""Quality rules against a restatement, on real prose of four languages and on texts spoiled in known ways."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from sievewright.llm.quality import quality_rules

PROSE = {
    "en": "The harbour lay quiet in the early light, and a few of the older men were already at work on the nets. It was not the kind of morning that a visitor would remember, but for those who lived there it was as good as any: the wind had turned to the west, the water was calm, and the boats that had been out for two days were expected before noon. In the small office by the pier a woman sat with a cup of tea and read the figures from the night before. She had done this for thirty years, and in all that time the numbers had never told her anything that she did not know from looking at the sky.",
    "fr": "Le port était calme dans la lumière du matin, et les plus anciens des pêcheurs travaillaient déjà sur les filets. Ce n'était pas une matinée dont un visiteur se souviendrait, mais pour ceux qui vivaient dans le village elle valait bien les autres : le vent avait tourné à l'ouest, la mer était plate et les bateaux partis depuis deux jours étaient attendus avant midi. Dans le petit bureau de la jetée, une femme lisait avec une tasse de thé les chiffres de la nuit. Elle le faisait depuis trente ans, et pendant tout ce temps les nombres ne lui avaient rien appris que le ciel ne lui eût dit par avance.",
    "de": "Der Hafen lag still im ersten Licht, und einige der älteren Männer arbeiteten schon an den Netzen. Es war nicht die Art von Morgen, an die sich ein Besucher erinnern würde, aber für die Leute im Dorf war er so gut wie jeder andere: Der Wind hatte auf West gedreht, das Wasser war ruhig, und die Boote, die seit zwei Tagen auf See waren, wurden vor dem Mittag erwartet. In dem kleinen Büro auf dem Steg saß eine Frau mit einer Tasse Tee und las die Zahlen der Nacht. Das tat sie seit dreißig Jahren, und in der ganzen Zeit hatten die Zahlen ihr nichts gesagt, was sie nicht auch von dem Blick in den Himmel gewusst hätte.",
    "es": "El puerto estaba tranquilo con la primera luz, y algunos de los hombres más viejos ya trabajaban en las redes. No era la clase de mañana que un visitante recordaría, pero para los que vivían en el pueblo era tan buena como las demás: el viento había girado al oeste, el agua estaba en calma y las barcas que llevaban dos días en el mar se esperaban antes del mediodía. En la pequeña oficina del muelle una mujer leía con una taza de té las cifras de la noche. Lo hacía desde hacía treinta años, y en todo ese tiempo los números no le habían dicho nada que no supiera por la forma del cielo.",
}


def spoiled(rng, text, how):
    words = text.split()
    if how == "symbols":
        return " ".join(w + rng.choice(("##", "$$", " %", " |", "*>")) for w in words)
    if how == "digits":
        return " ".join(w if rng.random() < 0.5 else str(rng.randint(0, 10**6)) for w in words)
    if how == "shouting":
        return text.upper()
    if how == "keywords":
        return " ".join(w for w in words if len(w) > 3)
    if how == "code":
        return " ".join(f"{w}_{i} = {{x[{i}]}};" for i, w in enumerate(words))
    return " ".join(words[:12] * 8)  # repetition


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    rows = [(t, lang, True) for lang, t in PROSE.items()] + [(t, f"{lang}-XX", True) for lang, t in PROSE.items()]
    rows += [(spoiled(rng, t, how), lang, False) for lang, t in PROSE.items() for how in ("symbols", "digits", "shouting", "keywords", "code", "repetition")]
    rows += [("Слово и дело. " + " ".join(f"слово{i}" for i in range(60)), "ru", True), (PROSE["en"], None, True), (PROSE["de"][:150], "de", True)]
    rows += [(None, "en", False), ("", "en", False), (" \n", None, False), ("w " * 100_000, "en", False), (" ".join(f"w{i}" for i in range(120_000)), "xx", True), ("short text of few words", "en", False)]
    return rows


def test_verdicts_equal_the_restatement(spark, rows):
    frame = spark.createDataFrame([(i, t, lang) for i, (t, lang, _) in enumerate(rows)], "doc_id bigint, text string, lang string").withColumn("quality", F.lit("clash")).withColumn("words", F.lit(1))
    frame = frame.unionByName(frame.where("doc_id < 2")).repartition(4)
    got = [(r["doc_id"], r["quality"]) for r in quality_rules(frame).select("doc_id", "quality").collect()]
    assert len(got) == len(rows) + 2
    for i, q in got:
        failed, classes, common, kept = brute.quality(*rows[i][:2])
        assert (q["base_failed"], q["kept"]) == (failed, kept), rows[i][1:]
        assert brute.close(q["class_distance"], classes) and brute.close(q["common_distance"], common)
    assert quality_rules(frame.limit(0)).count() == 0


def test_real_prose_stays_and_most_spoiled_texts_go(rows):
    good = [brute.quality(t, lang)[3] for t, lang, clean in rows if clean]
    bad = [not brute.quality(t, lang)[3] for t, lang, clean in rows if not clean]
    assert all(good) and sum(bad) / len(bad) >= 0.9, (good, bad)
