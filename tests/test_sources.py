import sqlite3
import struct

import pytest

from zonaria import __main__ as cli
from zonaria import errors
from zonaria.functions import formatting as fmt
from zonaria.sources import vector_files as V

OUTER = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]  # clockwise
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
FAR = [(9.0, 9.0), (9.0, 10.0), (10.0, 10.0), (9.0, 9.0)]


def shp(records):
    body = b""
    for k, rings in enumerate(records, 1):
        if rings is None:
            content = struct.pack("<i", 0)
        else:
            pts = [p for r in rings for p in r]
            starts = [sum(len(r) for r in rings[:j]) for j in range(len(rings))]
            content = struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(pts)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
        body += struct.pack(">2i", k, len(content) // 2) + content
    return b"\0" * 100 + body


def dbf(names):
    head = struct.pack("<4BIHH20x", 3, 1, 1, 1, len(names), 32 + 32 + 1, 1 + 10) + b"CVEGEO".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10]) + b"\0" * 15 + b"\r"
    return head + b"".join(b" " + n.encode("latin-1").ljust(10) for n in names)


def wkb(polygons, end="<"):
    b = 1 if end == "<" else 0
    one = lambda rings: struct.pack(f"{end}BII", b, 3, len(rings)) + b"".join(struct.pack(f"{end}I", len(r)) + b"".join(struct.pack(f"{end}2d", *p) for p in r) for r in rings)
    return one(polygons[0]) if len(polygons) == 1 else struct.pack(f"{end}BII", b, 6, len(polygons)) + b"".join(map(one, polygons))


def plain(rows):
    return {r["cvegeo"]: None if r["geometry"] is None else [[[(p["x"], p["y"]) for p in ring] for ring in poly] for poly in r["geometry"]] for r in rows}


def test_shapefile(spark, tmp_path):
    (tmp_path / "a.shp").write_bytes(shp([[OUTER, HOLE, FAR], None, [FAR]]))
    (tmp_path / "a.dbf").write_bytes(dbf(["Z1", "Zñ", " "]))
    got = plain(V.read_zones(spark, f"{tmp_path}/a.shp").collect())
    assert got == {"Z1": [[OUTER, HOLE], [FAR]], "Zñ": None, None: [[FAR]]}
    (tmp_path / "b.shp").write_bytes(shp([[OUTER]]))
    (tmp_path / "b.dbf").write_bytes(dbf(["B"]))
    assert V.read_zones(spark, f"{tmp_path}/*.shp").count() == 4
    with pytest.raises(FileNotFoundError):
        V.read_zones(spark, f"{tmp_path}/no.shp")
    with pytest.raises(errors.ContractError):
        list(V.shapes(b"\0" * 100 + struct.pack(">2i", 1, 2) + struct.pack("<i", 1)))


@pytest.mark.parametrize("end", "<>")
def test_geopackage(spark, tmp_path, end):
    path = tmp_path / "z.gpkg"
    con = sqlite3.connect(path)
    con.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    con.execute("insert into gpkg_geometry_columns values ('zonas', 'geom')")
    con.execute("create table zonas (fid integer, geom blob, CVEGEO text)")
    head = lambda flags, box=b"": b"GP\0" + bytes([flags]) + struct.pack("<i", 4326) + box
    rows = [(1, head(1) + wkb([[OUTER, HOLE]], end), "A"), (2, head(3, b"\0" * 32) + wkb([[OUTER], [FAR]], end), "B"), (3, None, "C"), (4, head(17), "D")]
    con.executemany("insert into zonas values (?, ?, ?)", rows)
    con.commit()
    con.close()
    d = V.read_zones(spark, str(path))
    assert plain(d.collect()) == {"A": [[OUTER, HOLE]], "B": [[OUTER], [FAR]], "C": None, "D": None}
    assert d.filter("cvegeo = 'A'").first()["properties"]["fid"] == "1"


def test_number_texts(spark):
    d = spark.createDataFrame([(1, 1234567.0), (2, -1234.0), (3, 12.4), (4, None), (5, float("nan")), (6, 2.5e9)], "k int, v double")
    short = {r["k"]: r["t"] for r in d.select("k", fmt.compact_short("v").alias("t")).collect()}
    assert short == {1: "1.23M", 2: "-1.2K", 3: "12", 4: "—", 5: "—", 6: "2,500.00M"}
    long = {r["k"]: r["t"] for r in d.filter("k in (1, 2, 3, 6)").select("k", fmt.compact_long("v", "$").alias("t")).collect()}
    assert long == {1: "$1.23M", 2: "-$1.23K", 3: "$12.40", 6: "$2.50B"}
    assert fmt.now_iso().endswith("+00:00")


def test_command_line(spark, data, tmp_path, capsys):
    assert cli.main(["--list"]) == 0 and "p1_found" in capsys.readouterr().out
    assert cli.main([data, "sector_ranking", "--out", f"{tmp_path}/r", "--format", "csv"]) == 0
    assert spark.read.option("header", True).csv(f"{tmp_path}/r").count() == 10
