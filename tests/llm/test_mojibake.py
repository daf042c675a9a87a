"""Planted damage: found and, where nothing is lost, restored exactly; clean text stays."""

import random

import pytest

from gleanery.llm.channels import PART, candidates, fits, pattern_of, readings, told_by_look
from gleanery.llm.mojibake import Repair, best_path

SENTENCES = [
    "Die größere Fläche wäre möglich, sagte der Prüfer über die Höhe.",
    "Le témoin traité reste vert, l’autre jaunit à la récolte déjà.",
    "La señal es débil: mañana se repetirá la toma con más luz.",
    "A lesão não mede três vezes mais; há dúvida quanto à mancha.",
    "Część etykiet usunięto, resztę należy jeszcze sprawdzić.",
    "Поражено около половины поверхности, нужно переснять.",
    "“Looks like rust to me” – the crew’s naïve guess…",
    "Yağmurdan sonra ışık yetersizdi, çekim yapılmadı.",
    "清晰度很低，无法判断病斑。",
    "At 12 °C the halos (±3 µm) looked 3½ × larger.",
]
CLEAN = ["NÃO É SÓ PÓ", "IRMÃ\nÄhre", "σ ≈ 0.3, √n = 22, Δ ≤ 1", "├── data\n│   └── x", "\ufeffplain", "a&amp;b &lt;tag&gt;", "Тёмный лес ещё стоит"]


def shown(text, codec):
    raw = text.encode("utf-8")
    return "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in raw)


def corpus(rng, n=1200):
    return ["\n".join(rng.choice(SENTENCES) for _ in range(rng.randrange(1, 5))) for _ in range(n)]


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(9)
    texts = corpus(rng)
    truth = {}
    docs = []
    for k, t in enumerate(texts):
        damaged = t
        if k % 25 == 0:
            lines = t.split("\n")
            j = rng.randrange(len(lines))
            codec = rng.choice(["cp1252", "latin-1", "cp1251", "cp1250", "cp437", "mac_roman"])
            lines[j] = shown(lines[j], codec)
            if rng.random() < 0.2 and codec == "cp1252":
                lines[j] = shown(lines[j], codec)
            damaged = "\n".join(lines)
        elif k % 100 == 1:
            damaged = SENTENCES[0].encode("cp1252").decode("cp437")
            t = SENTENCES[0]
        elif k % 100 == 2:
            damaged, t = SENTENCES[5].encode("cp1251").decode("latin-1"), SENTENCES[5]
        elif k % 100 == 3:
            damaged, t = SENTENCES[0].encode("utf-8").decode("ascii", "replace"), SENTENCES[0]
        if damaged != t:
            truth[k] = t
        docs.append((k, damaged, "x", "y"))
    docs += [(10_000 + j, c, "x", "y") for j, c in enumerate(CLEAN)]
    docs += [(20_000, None, "x", "y"), (20_001, "", "x", "y"), (20_002, " \n", "x", "y"), (None, "Ã¼ber", "x", "y"), (20_003, "ä" * 60_000, "x", "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string, key string, fixes string")
    return Repair(df), truth


def test_found(planted):
    repair, truth = planted
    got = {r[0] for r in repair.found().collect()}
    assert got == set(truth)


def test_restored(planted):
    repair, truth = planted
    rows = {r["doc_id"]: r for r in repair.restored().collect()}
    exact = sum(rows[k]["text"] == t for k, t in truth.items())
    assert exact >= 0.9 * len(truth)


def test_no_documents(spark):
    repair = Repair(spark.createDataFrame([], "doc_id long, text string"))
    assert repair.found().collect() == [] and repair.restored().collect() == []


def test_candidates_of_units():
    assert ("utf-8 as cp1252 x1", 1, "für") in candidates("fÃ¼r")
    assert ("utf-8 as cp1252 x2", 2, "für") in candidates("fÃƒÂ¼r")
    assert any(r == "für" for _, _, r in candidates("f&Atilde;&frac14;r"))
    assert any(r == "für" for _, _, r in candidates("fã¼r"))  # lower-cased after the damage
    assert candidates("plain") == []


def test_lost_characters_fit():
    assert pattern_of("gelöscht") == "gel*scht" == pattern_of("gel\ufffdscht")
    assert fits("gelöscht", "gel\ufffdscht") and fits("gelöscht", "gel\ufffd\ufffdscht")
    assert not fits("gelöscht", "gel\ufffd\ufffd\ufffdscht") and not fits("gelascht", "gel\ufffdscht")


def test_path_prefers_one_channel():
    pieces = [[("a", 3.0), ("b", 3.5)], [("a", 3.0)], [("a", 3.0), ("b", 1.0)]]
    assert best_path(pieces) == [0, 0, 0]
    assert best_path([[("a", 1.0)]]) == [-1]
    assert best_path([]) == []


def test_copies_of_damage_are_no_evidence(spark):
    rng = random.Random(3)
    clean = list(dict.fromkeys(corpus(rng, 60)))
    hurt = [shown(SENTENCES[0], "cp1252"), SENTENCES[5].encode("cp1251").decode("latin-1")]
    docs = list(enumerate(clean)) + [(10_000 + k, hurt[k % 2]) for k in range(4000)]
    docs += [(20_000 + k, f"{hurt[0]} No. {k}") for k in range(2000)]  # near copies: no equal texts
    got = {r[0] for r in Repair(spark.createDataFrame(docs, "doc_id long, text string")).found().collect()}
    assert got == {k for k, _ in docs if k >= 10_000}


def test_told_by_look():
    assert told_by_look("fÃ¼r") and told_by_look("РџРѕСЂР°Р¶РµРЅРѕ")
    assert not any(told_by_look(x) for x in ("für", "трёх", "рік", "CAFÉ…", "──┐", "清晰度", "NÃO"))


def test_lost_characters_of_other_scripts(spark):
    clean = [SENTENCES[5], SENTENCES[8], "Η φωτογραφία είναι καλή."]
    cases = {
        100: ("Пора\ufffdено около", "Поражено около"),
        101: ("около пол\ufffd\ufffdвины", "около половины"),  # a sign for each byte
        102: ("无法判\ufffd病斑。", "无法判断病斑。"),
        103: ("清晰度\ufffd\ufffd\ufffd低，无法", "清晰度很低，无法"),
        104: ("Η φω\ufffdογραφία", "Η φωτογραφία"),
        105: ("\ufffd\ufffd\ufffd около", "\ufffd\ufffd\ufffd около"),  # nothing left to tell by
    }
    docs = [(k, f"{t} {k}") for k in range(30) for t in [clean[k % 3]]] + [(k, d) for k, (d, _) in cases.items()]
    rows = {r["doc_id"]: r for r in Repair(spark.createDataFrame(docs, "doc_id long, text string")).restored().collect()}
    assert {k: rows[k]["text"] for k in cases} == {k: t for k, (_, t) in cases.items()}
    assert [k for k in cases if rows[k]["open"]] == [105]


def test_lattice_keeps_all_readings():
    assert readings("fÃ¼r", "cp1252") == [("für", False)]
    assert ("—", False) in readings("ΓÇö", "cp437") and ("’", True) not in readings("ΓÇö", "cp1252")
    assert len(readings("ΓÇö", "cp437")) > 1  # 'ö' may have been 'Ö', whose byte is another
    assert readings("Ã�", "latin-1") == [(chr(PART + 0xC3), False)]  # the first byte is known
    assert fits("für", "f" + chr(PART + 0xC3) + "r") and not fits("fłr", "f" + chr(PART + 0xC3) + "r")
    assert readings("plain", "cp1252") == [] and readings("ü" * 60_000, "cp1252") == []
    deep = "für"
    for _ in range(8):
        deep = shown(deep, "cp1252")
    assert ("utf-8 as cp1252 x8", 8, "für") in candidates(deep)


def test_measured_restoration(planted):
    """Of planted damage without lost bytes nearly all comes back exactly."""
    repair, truth = planted
    rows = {r["doc_id"]: r["text"] for r in repair.restored().collect()}
    whole = [k for k in truth if k % 100 != 3]
    rate = sum(rows[k] == truth[k] for k in whole) / len(whole)
    print(f"restored exactly: {rate:.3f} of {len(whole)}")
    assert rate >= 0.95
