"""Ratings ⋈ crosswalk with the three-key fallback, and the materiality rule."""

from tremor.operators import materiality as mat

R_SCHEMA = "isic_section string, isic_division string, isic_group string, isic_class string, svc_a string, svc_b string"
X_SCHEMA = "isic_section string, isic_division string, isic_group string, isic_class string, sector string"


def test_match_fallback_and_rule(spark):
    ratings = spark.createDataFrame([
        ("A", "01", "011", "0111", "VH", "M"),
        ("A", "01", "011", "0112", "H", "H"),
        ("A", "01", "011", "0119", "H", None),  # no class match → fallback on three keys
        ("B", "02", "021", "0211", "L", "H"),     # never matches
        (None, "03", "031", "0311", "H", "H"),    # null key matches null key
    ], R_SCHEMA)
    xwalk = spark.createDataFrame([
        ("A", "01", "011", "0111", "Crops"), ("A", "01", "011", "0112", "Crops"),
        (None, "03", "031", "0311", "Forestry")], X_SCHEMA)
    joined, unjoined = mat.match_ratings(ratings, xwalk, "all")
    assert unjoined.count() == 1
    # parity: all rows joined again on three keys → duplicates counted at group level
    assert joined.where("sector = 'Crops'").count() == 2 + 3 * 2
    joined_i, _ = mat.match_ratings(ratings, xwalk, "unmatched")
    assert joined_i.where("sector = 'Crops'").count() == 2 + 1 * 2
    counts = {(r.service, r.sector): (r.vh, r.h, r.n, r.material) for r in mat.materiality_counts(joined_i).collect()}
    assert counts[("svc_a", "Crops")] == (1, 3, 4, True)     # VH ≥ 1
    assert counts[("svc_b", "Crops")] == (0, 1, 4, False)   # 1/4 not above half, below three
    assert counts[("svc_b", "Forestry")] == (0, 1, 1, True)  # (VH+H)/n = 1 > 0.5
    assert counts[("svc_a", "Forestry")] == (0, 1, 1, True)  # 1/1 > 0.5
    out = {r.service: r.sectors for r in mat.materiality(joined_i).collect()}
    assert out["svc_a"] == ["Crops", "Forestry"]


def test_three_or_more_rule_and_null_denominator(spark):
    ratings = spark.createDataFrame([("S", "D", "G", f"C{i}", r, None) for i, r in enumerate(["H", "H", "H", "L", "L", "L", None])], R_SCHEMA)
    xwalk = spark.createDataFrame([("S", "D", "G", f"C{i}", "Sec") for i in range(7)], X_SCHEMA)
    joined, _ = mat.match_ratings(ratings, xwalk)
    c = {r.service: (r.vh, r.h, r.n, r.material) for r in mat.materiality_counts(joined).collect()}
    assert c["svc_a"] == (0, 3, 7, True)   # 3/7 < 0.5 but VH+H ≥ 3
    assert c["svc_b"] == (0, 0, 7, False)  # nulls count in the denominator only
    assert mat.service_columns(ratings) == ["svc_a", "svc_b"]
