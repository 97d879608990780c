import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zonaria.operators import rejects as R

GOOD = "0090003482,IMPRENTA,822147,0 a 5 personas,20.826707,-111.045039"
FIELD = re.compile(r'"(?:[^"]|"")*"|[^",]*')


def reference(line):
    """The rules by a scanner over the raw characters."""
    if not line:
        return ["columnas"]
    out, at = [], 0
    while True:
        m = FIELD.match(line, at)
        if m.end() < len(line) and line[m.end()] != ",":
            return ["comillas"]
        t = m.group()
        out.append(t[1:-1].replace('""', '"') if t.startswith('"') else t)
        if m.end() == len(line):
            break
        at = m.end() + 1
    if len(out) != 6:
        return ["columnas"]
    out = [x.strip() for x in out]
    num = lambda s, a, b: bool(re.fullmatch(r"[+-]?[0-9]+(\.[0-9]+)?", s)) and a <= float(s) <= b
    checks = (("id", re.fullmatch("[0-9]{10}", out[0])), ("codigo_act", re.fullmatch("[0-9]{6}", out[2])), ("latitud", num(out[4], 14, 33)), ("longitud", num(out[5], -119, -86)))
    return [n for n, ok in checks if not ok]


@pytest.mark.parametrize(
    "line, want",
    [
        (GOOD, []),
        (GOOD.replace("IMPRENTA", '"A ""B"", C\nD"'), []),
        (GOOD.replace("IMPRENTA", "A\nB\rC"), []),
        (GOOD.replace("IMPRENTA", 'A "B"'), ["comillas"]),
        (GOOD.replace("IMPRENTA", ' "B"'), ["comillas"]),
        (GOOD.replace("IMPRENTA", '"B" '), ["comillas"]),
        (GOOD.replace("IMPRENTA", '"B'), ["comillas"]),
        (GOOD + ",x", ["columnas"]),
        (GOOD.replace(",", ";"), ["columnas"]),
        ("", ["columnas"]),
        (None, ["columnas"]),
        ('""', ["columnas"]),
        (GOOD.replace("0090003482", " 0090003482\t"), []),
        (GOOD.replace("0090003482", "٠٠90003482"), ["id"]),
        (GOOD.replace("20.826707", "33.0000000000000000001"), ["latitud"]),
        (GOOD.replace("20.826707", "33"), []),
        (GOOD.replace("20.826707", "2e1"), ["latitud"]),
        (GOOD.replace("20.826707", "20."), ["latitud"]),
        (GOOD.replace("20.826707", "+20.5"), []),
        (",,,,,", ["id", "codigo_act", "latitud", "longitud"]),
    ],
)
def test_reasons(line, want):
    assert R.reasons(line)[0] == want


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(['"', '""', ",", "a", " ", "\n", "\r", "1", ".", "-"]), max_size=14).map("".join))
def test_structure_against_scanner(line):
    assert R.reasons(line)[0] == reference(line)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet='ab",\n\r é', max_size=6), min_size=6, max_size=6))
def test_round_trip(values):
    line = ",".join('"' + v.replace('"', '""') + '"' for v in values)
    assert R.fields(line) == values


def test_no_character_stands_for_a_line_end():
    odd = "caf\ue00abar\ue00d\ue000\ue001"
    assert R.fields(GOOD.replace("IMPRENTA", odd))[1] == odd
    assert R.fields(GOOD.replace("IMPRENTA", odd + "\n\r"))[1] == odd + "\n\r"


def test_files_of_physical_lines(spark, rows):
    """Records with line ends in their quotes are assembled before they are parsed; those without quotes stay apart."""
    two = GOOD.replace("IMPRENTA", '"A\nB ""C""\n"')
    lines = [*two.split("\n"), GOOD, GOOD.replace("822147", "x")]
    df = spark.createDataFrame([("f", k, t) for k, t in enumerate(lines)], "archivo string, n int, t string")
    got = {r["n"]: (r["motivos"], r["campos"]) for r in R.parsed_file(df, "archivo", "n", "t").collect()}
    assert got[0] == ([], R.fields(two)) and got[3] == ([], R.fields(GOOD)) and got[4][0] == ["codigo_act"] and len(got) == 3
    recs = spark.createDataFrame([("f", 1, two), ("f", 2, GOOD), ("f", 3, '"a'), ("f", 4, "a\nb"), ("g", 1, ""), ("g", 2, None), ("g", 3, '"x\n\n"')], "archivo string, linea_no int, linea string")
    assert rows(R.reassembled(recs)) == [("f", 1, two), ("f", 2, GOOD), ("g", 1, ""), ("g", 3, '"x\n\n"')]


def test_frames(spark, rows):
    long = '"' + "x" * 300_000 + '"'
    data = [(1, "f", GOOD), (2, "f", None), (3, "f", GOOD.replace("IMPRENTA", long)), (4, "f", GOOD.replace("822147", "82214")), (4, "f", GOOD.replace("822147", "82214")), (5, "f", 'a"b')]
    df = spark.createDataFrame(data, "linea_id long, archivo string, linea string").selectExpr("*", "'z' as motivos", "'q' as ID", "1 as campos", "2 as n")
    assert rows(R.rejected(df)) == [(2, "columnas"), (4, "codigo_act"), (4, "codigo_act"), (5, "comillas")]
    good = R.loaded(df)
    assert rows(good, "linea_id", "n", "id", "latitud") == [(1, 2, "0090003482", 20.826707), (3, 2, "0090003482", 20.826707)]
    assert good.filter("linea_id = 3").first()["nom_estab"] == "x" * 300_000
    assert R.rejected(df.limit(0)).count() == 0 and R.loaded(df.limit(0)).count() == 0


def test_assemble(spark, rows):
    text = ['a,"b', 'c",d', "e", '"f""', "g", '",h', "i"]
    df = spark.createDataFrame([("x", k, t) for k, t in enumerate(text)] + [("y", 0, "z")], "archivo string, n int, t string")
    for block in (1, 2, 100):
        assert rows(R.assemble(df, "archivo", "n", "t", block)) == [("x", 0, 'a,"b\nc",d'), ("x", 2, "e"), ("x", 3, '"f""\ng\n",h'), ("x", 6, "i"), ("y", 0, "z")]
