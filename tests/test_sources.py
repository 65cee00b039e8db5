"""Raw recordings read in byte ranges."""

from bilateral.sources import recordings


def test_long_files_are_split(spark, tmp_path):
    at = tmp_path / "u1" / "left"
    at.mkdir(parents=True)
    n = 5000
    (at / "EDA.csv").write_text("1700000000.0\n4.0\n" + "".join(f"{i / 7:.4f}\n" if i % 11 else "\n" for i in range(n)) + "9.5\n\n \n")
    (at / "ACC.csv").write_bytes(b"1700000000.0, 1700000000.0\r\n32.0, 32.0\r\n1,2\r\n3,x\r\n")
    (at / "tags.csv").write_text("1\n2\n3\n")
    (tmp_path / "u2" / "right").mkdir(parents=True)
    (tmp_path / "u2" / "right" / "EDA.csv").write_text("1700000000.0\n4.0\n")
    (tmp_path / "u2" / "right" / "BVP.csv").write_text("")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    found = []
    try:
        for size in (None, "1500"):
            for k in old:
                spark.conf.set(k, size or old[k].removesuffix("b"))
            rec, samples = recordings.raw_csv(spark, str(tmp_path))
            if size:
                assert spark.read.text(str(tmp_path), recursiveFileLookup=True).rdd.getNumPartitions() > 8
            found.append((sorted(map(tuple, rec.collect())), sorted(((*r[:5], tuple(r.axes)) for r in samples.collect()), key=str)))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert found[0] == found[1]
    rec, samples = found[0]
    assert rec == [("ACC", "left", "u1", "lab", 1.7e9, 32.0), ("EDA", "left", "u1", "lab", 1.7e9, 4.0), ("EDA", "right", "u2", "lab", 1.7e9, 4.0)]
    eda = {r[4]: r[5] for r in samples if r[0] == "EDA"}
    assert set(eda) == set(range(n + 1)) and eda[n] == (9.5,) and all(v == ((None,) if i % 11 == 0 else (round(i / 7, 4),)) for i, v in eda.items() if i < n)
    assert sorted(r[5] for r in samples if r[0] == "ACC" and r[4] == 0) == [(1.0, 2.0)] and [r[5] for r in samples if r[0] == "ACC" and r[4] == 1] == [(3.0, None)]
