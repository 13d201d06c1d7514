"""The three commands on planted genomes and reads."""

import random

from seqlake import cli


def test_build_identify_subsample(spark, tmp_path):
    r = random.Random(3)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    base = dna(3000)
    genomes = {"aa": base, "ab": base[:1500] + "A" + base[1501:], "b": dna(3000), "c": dna(3000)}
    (tmp_path / "g").mkdir()
    for name, seq in genomes.items():
        (tmp_path / "g" / f"{name}.fna").write_text(f">{name}\n{seq}\n")
    b = genomes["b"]
    (tmp_path / "r.fq").write_text("".join(f"@{i}\n{b[i : i + 100]}\n+\n{'I' * 100}\n" for i in range(0, 2900, 10)))
    g, db, out = (str(tmp_path / x) for x in ("g", "db", "out"))
    cli.main(["build", "-i", g, "-o", db, "-n", "50"])
    cli.main(["identify", "-i", str(tmp_path / "r.fq"), "-d", db, "-o", out, "-b", "-p", "2", "-q", g])
    report = spark.read.csv(f"{out}/report", sep="\t", header=True).collect()
    assert [x.name for x in report] == ["b"] and float(report[0].relative_abundance) == 1 and float(report[0]["cov"]) > 0.9
    covered, total = map(int, report[0].covered_total.split("/"))
    assert 0.9 * total < covered <= total
    assert [x.name for x in spark.read.csv(f"{out}/singles", sep="\t", header=True).collect()] == ["b"]
    assert {"valid", "remain", "exist_evidence", "covered_total", "final_depth"} <= set(spark.read.csv(f"{out}/clusters", sep="\t", header=True).columns)
    assert [x.name for x in spark.read.csv(f"{out}/plasmids/report", sep="\t", header=True).collect()] == ["b"]
    assert spark.read.csv(f"{out}/probabilities", sep="\t", header=True).count() <= 3
    cli.main(["subsample", "-i", g, "-o", str(tmp_path / "s"), "-d", "0.95"])
    assert {x.name for x in spark.read.csv(str(tmp_path / "s/representatives"), sep="\t", header=True).collect()} == {"aa", "b", "c"}
