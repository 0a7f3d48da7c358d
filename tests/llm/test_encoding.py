import pytest

from inkwell.llm import encoding

CLEAN = ["Die späte Brücke über die Straße wurde für Gäste geöffnet", "À l’été, la forêt préférée a été rénovée près de la côte",
         "Żółta łąka i święta wieś, która była później zwrócona", "Новая мельница около реки была снова построена весной", "“We moved the café,” she said"]


@pytest.mark.parametrize("source,read_as", [("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "mac_roman")])
def test_undo_is_the_inverse(source, read_as):
    name = f"{source.replace('utf-8', 'utf_8')}>{read_as}"
    t = encoding.hypotheses()[name]
    for text in CLEAN[:2]:
        table = encoding._table(read_as)
        garbled = "".join(table[b] for b in text.encode(source))
        assert t.undo(garbled) == text


def test_twice_and_impossible():
    t = encoding.hypotheses()["utf_8>cp1252x2"]
    once = "für".encode().decode("cp1252")
    assert t.undo(once.encode().decode("cp1252")) == "für"
    assert t.undo("für") is None and t.undo("plain") is None
    assert encoding.hypotheses()["utf_8>cp1252"].undo("日本") is None


def test_pairs_are_explained_by_their_gaps():
    assert "utf_8>cp1252" in encoding.explain("fÃ¼r GÃ¤ste", "für Gäste")
    assert "cp1252>mac_roman" in encoding.explain("f¸r", "für")
    assert encoding.explain("fär", "für") == [] and encoding.explain("für", "für") == [] and encoding.explain("f�r", "für") == []


def test_fewest_transformations():
    got = encoding.fewest({"utf_8>cp1252 utf_8>cp1254": 9, "utf_8>cp1252": 1, "cp1252>cp437 cp1250>cp437": 3, "cp850>cp437": 1})
    assert got == {"utf_8>cp1252": 10, "cp1252>cp437": 3}


def corpus():
    rows = [(d, n, text) for d in range(40) for n, text in enumerate(CLEAN, 1)]
    bad = []
    for d, (read_as, source) in enumerate([("cp1252", "utf-8"), ("cp437", "utf-8"), ("cp437", "cp1252"), ("mac_roman", "cp1252")], 100):
        table = encoding._table(read_as)
        bad += [(d, n, "".join(table[b] for b in CLEAN[i].encode(source))) for n, i in ((1, 0), (2, 1))]
    bad.append((104, 1, "Die sp�te Br�cke"))
    part = CLEAN[0].replace("Straße", "StraÃŸe").replace("für", "fÃ¼r")
    return rows, [*bad, (105, 1, part)]


def test_garbled_lines_are_found_and_restored(spark):
    rows, bad = corpus()
    harmless = [(200, 1, "Prices: £12, ¥900 and ¢50 ®"), (200, 2, "├── src/index.dat"), (200, 3, "NÃO É ASSIM"), (200, 4, None), (200, 5, ""), (200, 6, "ascii")]
    df = spark.createDataFrame(rows + bad + bad + harmless, "doc_id bigint, line_no int, line string")
    got = {(r.doc_id, r.line_no): r for r in encoding.garbled_lines(df).collect()}
    assert set(got) == {(d, n) for d, n, _ in bad}
    for d in range(100, 104):
        assert got[d, 1].restored == CLEAN[0] and got[d, 2].restored == CLEAN[1]
    assert got[105, 1].restored == CLEAN[0]
    assert got[104, 1].restored == "Die späte Brücke" and got[104, 1].transformation is None


def test_no_break_spaces_second_runs_and_rare_characters(spark):
    rows, bad = corpus()
    rare = [(400 + d, 1, "Дом № 5 стоит около реки") for d in range(2)]
    much = [(d, 10 + n, "The bridge was moved to the river in the night and nobody had seen it. " * 40) for d in range(200) for n in range(2)]
    two = "Die spÃ¤te BrÃ¼cke über die Straße, für Gäste und später r├®nov├®e pr├®f├®r├®e"
    lines = {1: "La\u00a0prÃ©fÃ©rÃ©e", 2: "prÃ©fÃ©rÃ©e.\u00a0", 3: two, 4: "Дом № 5 стоит около реки".encode().decode("cp1251", "ignore")}
    df = spark.createDataFrame([*rows, *bad, *rare, *much, *((500, n, x) for n, x in lines.items())], "doc_id bigint, line_no int, line string")
    got = {r.line_no: r.restored for r in encoding.garbled_lines(df).where("doc_id = 500").collect()}
    assert got[1] == "La\u00a0préférée" and got[2] == "préférée.\u00a0"
    assert got[3] == "Die späte Brücke über die Straße, für Gäste und später rénovée préférée"
    assert "№" in got[4]


def test_long_lines_and_empty_tables(spark):
    long = " ".join(["für"] * 30_000 + ["fÃ¼r"] * 3)
    rows, bad = corpus()
    df = spark.createDataFrame([*rows, *bad, (300, 1, long)], "doc_id bigint, line_no int, line string")
    got = {(r.doc_id, r.line_no): r.restored for r in encoding.garbled_lines(df).where("doc_id = 300").collect()}
    assert got == {(300, 1): " ".join(["für"] * 30_003)}
    assert encoding.garbled_lines(df.limit(0)).collect() == []
    assert encoding.garbled_lines(df.where("doc_id = 0 AND line_no = 99")).collect() == []


def test_learned_mappings_are_applied_before_the_encoding():
    t = encoding._with_mappings({"utf_8>cp1252": {"Ã¼": "ü", "Ã¤": "Ä"}}, [])["utf_8>cp1252"]
    assert t.undo("fÃ¼r GÃ¤ste") == "für GÄste"  # a mapping says so, against the encoding
    assert t.undo("fÃ¼r spÃ¶t") == "für spöt"  # no pair showed ö: the encoding
    assert encoding.hypotheses()["utf_8>cp1252"].mappings == {}


def test_an_unlisted_mix_up_is_learned_from_twins(spark):
    # characters exchanged by a table that is no encoding's: one to one, and one to two
    table = dict(zip("äöüßéèàôçâ", "ⱥⱦⱨⱪⱬⱱⱳⱶⱸⱺ"))
    double = {c: "ꙁ" + x for c, x in zip("äöüßéèàôçâ", "ꙃꙅꙇꙉꙋꙍꙏꙑꙓꙕ")}
    words = ["späte", "Brücke", "Straße", "Gäste", "geöffnet", "forêt", "préférée", "rénovée", "côte", "Mühle", "Hütte", "schön", "grün", "für", "Höhe", "Länge", "große", "weiß",
             "déjà", "voilà", "très", "après", "reçu", "leçon", "âge", "pâte", "hôtel", "tôt", "père", "mère", "holà", "garçon", "mâle", "fête", "tête"]
    rows = [(d, 1, " ".join(words[(d + k) % len(words)] for k in range(12))) for d in range(600)]
    swap = lambda t, m: "".join(m.get(c, c) for c in t)
    bad = [(1000 + d, 1, swap(rows[d][2], table if d % 2 else double)) for d in range(80)]
    df = spark.createDataFrame(rows + bad, "doc_id bigint, line_no int, line string")
    got = {r.doc_id: (r.transformation, r.restored) for r in encoding.garbled_lines(df).collect()}
    assert set(got) == {d for d, _, _ in bad}
    for d in (d for d, _, _ in bad if "ê" not in rows[d - 1000][2]):  # which stays as it is and parts a line's runs
        assert got[d] == ("learned>1" if d % 2 else "learned>2", rows[d - 1000][2])


def test_words_that_merely_differ_teach_nothing():
    counts = encoding.np.zeros(encoding.UNI)
    counts[ord("ä")] = 1000
    assert encoding.own_mappings([("ä", "ü", 5, 40)], counts) == []
    counts[ord("ⱥ")] = 40
    assert [t.mappings for t in encoding.own_mappings([("ä", "ü", 5, 40), ("ⱥ", "ä", 5, 40)], counts)] == [{"ⱥ": "ä"}]
