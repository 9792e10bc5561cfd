"""Frames of a kinetics figure."""

from titrelake.operators import panels
from titrelake.operators.comparability import comparable_groups


def test_panels(spark):
    rows = []
    curve = {0.0: 1, 7.0: 6, 14.0: 8, 28.0: 6, 60.0: 3, 90.0: 2}
    for s in range(25):
        for arm, factor in (("IN", 1.0), ("IM", 0.5), (None, 0.25)):
            rows += [(len(rows) + i, f"{arm}{s}", arm, d, factor * v * (1 + 0.02 * (s % 5)), "nasal", "nasosorption", "IgA", "elisa_binding", "ug_ml", "lab_1") for i, (d, v) in enumerate(curve.items())]
        rows += [(len(rows) + i, f"r{s}", "IN", d, 1.0 + d + s * 0.1, "serum", "serum", "IgG", "elisa_binding", "ug_ml", "lab_2") for i, d in enumerate((0.0, 7.0, 14.0, 28.0, 60.0))]
        rows += [(len(rows), f"z{s}", "IN", 7.0, 0.0, "oral", "saliva", "IgG", "elisa_binding", "ug_ml", "lab_2")]
        rows += [(len(rows) + i, f"f{s}", "IN", d, v, "oral", "saliva", "IgA", "elisa_binding", "ug_ml", "lab_2") for i, (d, v) in enumerate(((0.0, 1.0), (7.0, 3.0), (14.0, None)))]
    names = "row_ord long, subject_id string, arm_id string, day double, value double, compartment string, method string, isotype string, assay string, unit string, lab string"
    d = spark.createDataFrame(rows, names)
    got = panels.kinetics_panels(d, n_boot=30, points=5)
    rows = got["marks"].collect()
    marks = {(r.series_key.split(" | ")[0], r.arm_id): r for r in rows if "IgG" not in r.series_key or "serum" in r.series_key}
    assert len(marks) == 5 and [r.note for r in rows if "oral | saliva | IgG" in r.series_key] == ["IN, saliva (lab_2): no positive values"]
    groups = {r.series_key: r.grp for r in comparable_groups(d).collect()}
    assert len(set(groups.values())) == 3 + 1 and all(r.grp == groups[r.series_key] for r in marks.values())
    for arm in ("IN", "IM", "?"):
        m = marks["nasal", arm]
        assert m.identifiable and 7 <= m.peak_day <= 28 and m.note is None and m.note_day is None
    assert marks["serum", "IN"].peak_day is None  # it rises to the last visit
    few = marks["oral", "IN"]
    assert (few.identifiable, few.peak_day, few.note_day, few.note_value) == (False, None, 7.0, 3.0) and few.note == "IN, saliva (lab_2): not identifiable: timepoints 2"
    points = got["points"].collect()
    assert len(points) == 3 * 6 + 5 + 2 + 1 and all(r.n == 25 for r in points)
    lines = got["curves"].collect()
    assert {(r.series_key.split(" | ")[0], r.arm_id) for r in lines} >= {("nasal", "IN"), ("nasal", "IM")} and not any(r.series_key.startswith("oral") for r in lines)
    assert all(r.lo is None or r.lo <= r.mid <= r.hi for r in lines)
    assert panels.kinetics_panels(d.limit(0), n_boot=2, points=3)["marks"].count() == 0
