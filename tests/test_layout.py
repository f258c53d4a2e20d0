import json

import numpy as np
import plain_adjust as plain
import pytest
from pyspark.sql import functions as F

from spatiotrack.functions import rings as rg
from spatiotrack.operators import adjust as ad
from spatiotrack.operators import diagnostics as dg
from spatiotrack.operators import evaluation as ev
from spatiotrack.operators.calibration import match_scanners
from spatiotrack.sources import files

SQUARE = np.array([[0, 0], [100, 0], [100, 100], [0, 100]], float)


def test_layout_survives_broken_and_missing_files(spark, tmp_path):
    assert files.receivers(files.read_layout(spark, str(tmp_path / "none.json"))).count() == 0
    p = tmp_path / "bad.json"
    p.write_text('{"floor": [')
    assert files.receivers(files.read_layout(spark, str(p))).count() == 0


def test_import_never_overwrites(spark, tmp_path):
    store = str(tmp_path / "store")
    text = lambda t: spark.createDataFrame([(t,)], "value string")
    doc = json.dumps({"floor": [{"name": "f", "scale": 40.0, "receivers": [{"entity_id": "a", "cords": {"x": 1.0, "y": 2.0}}, {"entity_id": ""}]}]})
    assert files.import_once(text("  "), store) == "blank"
    assert files.import_once(text("{broken"), store) == "broken"
    assert files.import_once(text(doc), store) == "imported"
    assert files.import_once(text(doc), store) == "kept"
    assert [r.scanner for r in files.receivers(files.read_layout(spark, store)).collect()] == ["a"]


@pytest.mark.parametrize("name", ["../x", "/etc/x", "", "a.exe", "..", "a/b.png"])
def test_names_stay_in_their_folder(name):
    with pytest.raises(ValueError):
        files.child_path("/maps", name, (".png",))


def test_recording_skips_broken_lines(spark, tmp_path):
    lines = [{"type": "header", "started": 1.0, "scales": {"f": 40.0}}, {"ent": "a", "updated": 2.0, "cords": [0, 0], "floor": "f"}, {"updated": 3.0}, {"ent": "a", "updated": None, "cords": [3, 4], "floor": "f"}]
    p = tmp_path / "rec.jsonl"
    p.write_text("\n".join(map(json.dumps, lines)) + '\n\n{"ent": "a", "upd')
    samples, scales = ev.read_recording(spark, str(p))
    assert sorted(r.updated for r in samples.collect()) == [0.0, 2.0] and scales.first().scale == 40.0
    rows = samples.withColumn("seq", F.monotonically_increasing_id())
    assert ev.steps(rows).first().step == 5.0


def test_clip_and_hull():
    other = SQUARE + 50
    assert sum(rg.signed_area(r) for r in rg.clip(SQUARE, other, True)) == pytest.approx(2500)
    assert sum(rg.signed_area(r) for r in rg.clip(SQUARE, other, False)) == pytest.approx(7500)
    assert rg.clip(SQUARE, SQUARE, False) == []
    assert rg.smallest_rectangle(SQUARE)[1] == pytest.approx(10000)


def test_rooms_are_squared_welded_and_kept_apart():
    rooms = [np.array([[0, 0], [100, 3], [102, 98], [-2, 101]], float), np.array([[105, 2], [200, 0], [200, 100], [108, 104]], float)]
    out, squared, _ = plain.adjust_group(rooms)
    assert squared == [True, True]
    assert sum(abs(rg.signed_area(r)) for r in rg.clip(rg.turned(out[0]), rg.turned(out[1]), True)) < 1


def test_l_shape_stays_and_larger_room_keeps_the_overlap():
    shape = np.array([[0, 0], [300, 0], [300, 100], [100, 100], [100, 300], [0, 300]], float)
    assert not ad.square(shape)[1]
    big, small = SQUARE * 3, SQUARE + [250, 100]
    out, _, _ = plain.adjust_group([big, small], straighten=False)
    assert abs(rg.signed_area(out[0])) == pytest.approx(90000) and abs(rg.signed_area(out[1])) < 10000


def test_scanner_tokens_match_once_taken(spark):
    placed = spark.createDataFrame([("hall", None), ("old_a1b2c3", None), ("kitchen", "a1b2c5")], "slug string, uid string")
    scanners = spark.createDataFrame([("AA:BB:CC:A1:B2:C3", "Hall"), ("00:00:00:a1:b2:c6", "New"), ("00:00:00:a1:b2:c4", "Other a1b2c3")], "address string, name string")
    got = {r.slug: (r.address, r.tier) for r in match_scanners(placed, scanners).collect()}
    assert got["hall"] == ("aa:bb:cc:a1:b2:c3", 1) and got["kitchen"][1] == 2


def test_all_renamed_scanners_are_matched(spark):
    # Forty of their own, and a chain in which each match makes the next one unique.
    own = [(f"old_{i:02x}00{i:02x}", None, f"11:22:33:{i:02x}:00:{i:02x}") for i in range(40)]
    chain = [(f"z{i:02d}", f"bb00{i:02x}", f"11:22:33:bb:00:{i + 3:02x}") for i in range(40)]
    placed = spark.createDataFrame([(a, b) for a, b, _ in own + chain], "slug string, uid string")
    scanners = spark.createDataFrame([(c, f"New {i}") for i, (_, _, c) in enumerate(own + chain)], "address string, name string")
    got = {r.slug: r.address for r in match_scanners(placed, scanners).collect()}
    assert got == {a: c for a, _, c in own + chain}


def test_similar_names_are_suggested(spark):
    unmatched = spark.createDataFrame([("kitchen_probe", None), ("zzz", None)], "scanner string, uid string")
    free = spark.createDataFrame([("kitchen_prob",), ("garage",)], "scanner string")
    got = {r.scanner: r.suggested for r in dg.suggest(unmatched, free).collect()}
    assert got == {"kitchen_probe": "kitchen_prob", "zzz": None}


def test_peeling_ends_at_ambiguous_slugs_and_grows_with_the_input(spark):
    # Two slugs that share both candidates stay open; of two that want one address the least gets it.
    placed = spark.createDataFrame([("a_1", "cc0001"), ("b_1", "cc0001"), ("c_1", "dd0001"), ("d_1", "dd0001"), ("e_1", "not-hex"), ("f_1", None)], "slug string, uid string")
    scanners = spark.createDataFrame([("11:22:33:cc:00:01", "X"), ("11:22:33:cc:00:02", "Y"), ("11:22:33:dd:00:03", "Z"), (None, "N"), ("11:22:33:ff:ff:ff", None)], "address string, name string")
    got = {r.slug: r.address for r in match_scanners(placed, scanners).collect()}
    assert got == {"c_1": "11:22:33:dd:00:03"}
    many = spark.range(20000).selectExpr("concat('old_', id, '_', lower(lpad(hex(id * 16 + 8), 6, '0'))) AS slug", "cast(null AS string) AS uid")
    addresses = spark.range(20000).selectExpr("concat('aa', 'bb', 'cc', lpad(hex(id * 16 + 8 + id % 3), 6, '0')) AS address", "concat('n ', id) AS name")
    matched = match_scanners(many, addresses)
    assert matched.count() == 20000 and matched.filter("tier = 2 and substring_index(slug, '_', -1) > right(address, 6)").count() == 0


def test_suggestions_equal_all_pairs(spark):
    import difflib
    import random

    rng = random.Random(8)
    parts = "kitchen hall office lab probe room den attic garage north south 1 2 3 esp32 ble proxy küche".split()
    names = sorted({"_".join(rng.sample(parts, rng.randint(1, 3))) for _ in range(260)})
    free, rows = names[::2], [(n, rng.choice([None, None, None, "a1b2c3"])) for n in names[1::2]] + [("zzzzzz", None), ("", None), (free_token := "x_a1b2c3", None)]
    free = [*free, "probe_a1b2c3", "qq"]
    assert free_token
    got = {r.scanner: r.suggested for r in dg.suggest(spark.createDataFrame(rows, "scanner string, uid string"), spark.createDataFrame([(n,) for n in free], "scanner string")).collect()}
    for name, uid in rows:
        token = uid or ("a1b2c3" if name.endswith("_a1b2c3") else None)
        if token:
            want = "probe_a1b2c3"
        else:
            ratio, _, best = max((difflib.SequenceMatcher(None, name, o).ratio(), -i, o) for i, o in enumerate(sorted(free)))
            want = best if ratio >= 0.55 else None
        assert got[name] == want, name
