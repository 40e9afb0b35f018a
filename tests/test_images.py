"""Image listings and estimates at their edges."""

import pytest

from lattiq.sources import image_sets, sinks


def test_first_place_wins_and_empty_files_do_not_count(spark, tmp_path):
    ea = tmp_path / "d1" / "results" / "EA"
    for place in ("maps_dataset/rgb", "visualizations"):
        (ea / place).mkdir(parents=True)
    (ea / "a_rgb.png").write_bytes(b"x")
    (ea / "maps_dataset/rgb/a_rgb.png").write_bytes(b"x")
    (ea / "visualizations/b_rgb.png").write_bytes(b"x")
    (ea / "c_rgb.png").write_bytes(b"")
    (ea / "visualizations/d.png").write_bytes(b"x")
    images = image_sets.image_files(spark, str(tmp_path))
    assert {(r.dataset_name, r.uid, r.filepath.split("/EA/")[1]) for r in images.collect()} == {("d1", "a", "maps_dataset/rgb/a_rgb.png"), ("d1", "b", "visualizations/b_rgb.png")}

    schema = "dataset_name string, uid string, map_size string, topographic_error double, dead_neuron_ratio double, filepath string"
    rows = [("d1", "a", "[4, 5]", 0.01, 0.01, "old"), ("d1", "b", "[4,", 0.2, 0.2, None), ("d1", "c", None, 0.9, 0.0, None), ("d2", "a", "[7, 7]", 0.9, 0.0, None), (None, None, "[1, 2, 3]", None, None, None)]
    rows = image_sets.with_map_size(spark.createDataFrame(rows, schema))
    assert [(r.map_width, r.map_height) for r in rows.collect()] == [(4, 5), (0, 0), (0, 0), (7, 7), (0, 0)]
    got = image_sets.labelled_images(rows, images).collect()
    assert [(r.uid, r.quality_score, r.label_source, r.map_width) for r in got] == [("a", 0.9, "auto_good", 4)] and "old" not in got[0].filepath
    every = image_sets.labelled_images(rows, images, unlabelled=True).collect()
    assert {(r.uid, r.quality_score) for r in every} == {("a", 0.9), ("b", None)}
    assert {(r.dataset_name, r.n_rows, r.n_images) for r in image_sets.coverage(rows, images).collect()} == {("d1", 3, 2), ("d2", 1, 0), (None, 1, 0)}


def test_tasks_write_files_that_share_folders(spark, tmp_path):
    for _ in range(2):  # again: the same files
        rows = spark.range(300).selectExpr("concat('d', id % 2, '/results/EA/visualizations/', id, '_rgb.png') AS path", "concat('é', id) AS value")
        assert sinks.write_files(rows.repartition(7), f"file://{tmp_path}") == 300
    assert sinks.write_files(rows.where("false"), str(tmp_path)) == 0
    files = [p for p in tmp_path.rglob("*") if p.is_file()]
    assert len(files) == 300 and len({p.parent for p in files}) == 2  # no folder a file
    assert (tmp_path / "d1/results/EA/visualizations/7_rgb.png").read_text(encoding="utf-8") == "é7"
    assert image_sets.image_files(spark, str(tmp_path)).count() == 300


def test_estimates_come_from_the_nearest_group_that_has_any(spark):
    rows = [(1, "g", "d", 4.0, 1.0), (2, "g", "d", 8.0, 3.0), (3, "g", "d", None, 1.0), (4, "h", "d", float("nan"), 1.0), (5, None, None, 5.0, None), (6, "h", "e", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "id int, g string, d string, m double, s double")
    got = {r.id: (r.from_group, r.est_low, r.est_high) for r in image_sets.estimated_ranges(df, "m", "s", [["d", "g"], ["d"], []]).collect()}
    assert got[1] == (0, 2.0, 6.0) and got[6] == (0, 0.0, 5.0)
    pooled = (5.0 + 4.0) ** 0.5  # within: (1 + 9) / 2, between: 4
    assert got[3] == (1, pytest.approx(6 - 2 * pooled) if 6 > 2 * pooled else 0.0, pytest.approx(6 + 2 * pooled))
    assert got[4][0] == 2 and got[5][0] == 3 and len(got) == 6
    none = df.where("m IS NULL")
    assert [(r.from_group, r.est_low, r.est_high) for r in image_sets.estimated_ranges(none, "m", "s", [["g"], []]).collect()] == [(None, None, None)]
