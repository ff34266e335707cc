import random

from pyspark.sql import functions as F

from labspark.operators import nucleic


def test_off_targets_by_brute_force(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("ACGT") for _ in range(3000))
    guides = [(i, text[100 * i : 100 * i + 20]) for i in range(6)]
    sites = []
    for i, g in guides:
        for edits in (0, 1, 2, 2, 3, 4):
            own = list(g)
            for at in rng.sample(range(20), edits):
                own[at] = rng.choice([c for c in "ACGT" if c != own[at]])
            sites.append((len(sites), "".join(own)))
    sites += [(1000 + i, "".join(rng.choice("ACGT") for _ in range(20))) for i in range(200)]
    got = nucleic.off_targets(spark.createDataFrame(guides, "guide_id int, guide string"), spark.createDataFrame(sites, "id int, site string"))
    far = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    assert sorted((r.guide_id, r.id, r.mismatches) for r in got.collect()) == sorted((i, j, far(g, s)) for i, g in guides for j, s in sites if far(g, s) <= 2)


def test_sites_on_both_strands(spark):
    guide = "ACGTTGCAACGTTGCAACGT"
    seq = "TT" + guide + "TGG" + "AA"
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = spark.createDataFrame([("f", seq), ("r", back), ("none", "ACG"), ("null", None)], "id string, seq string")
    got = {(r.id, r.strand, r.position, r.site) for r in nucleic.guide_sites(rows, "id", "seq").collect()}
    assert got == {("f", "+", 2, guide), ("r", "-", len(seq) - 22, guide)}


def test_features_and_forbidden_patterns(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    part = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    seq = F.lit("AACCGGTTAC")
    assert one(nucleic.feature_sequence(seq, F.array(part(0, 2), part(4, 6)), F.lit(False))) == "AAGG"
    assert one(nucleic.feature_sequence(seq, F.array(part(8, 2)), F.lit(False))) == "ACAA"
    assert one(nucleic.feature_sequence(seq, F.array(part(0, 4)), F.lit(True))) == "GGTT"
    assert one(nucleic.forbidden(F.lit("AAGAGACCTTTTTTT"), ("GGTCTC", "GAATTC"), 6)) == ["GGTCTC", "run:7"]
    assert one(nucleic.forbidden(F.lit(""), ("GGTCTC",), 6)) == []
