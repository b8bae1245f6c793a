from spreadforge.config import TRANSITIONS
from spreadforge.functions.selection import build_xcols
from spreadforge.plans.catalog import feature_panel_columns


def test_feature_counts_per_horizon():
    cols = feature_panel_columns()
    got = {t.name: len(build_xcols(cols, t.tokens, t.always)) for t in TRANSITIONS}
    # 59 / 85 / 114 / 142 for transitions starting at DAM / IDA1 / IDA2 / IDA3
    assert got["DAM→IDA1"] == 59 and got["DAM→BM"] == 59
    assert got["IDA1→BM"] == 85 and got["IDA1→IDA2"] == 85
    assert got["IDA2→IDA3"] == 114 and got["IDA2→BM"] == 114
    assert got["IDA3→BM"] == 142


def test_selection_excludes_targets_and_strict_gate():
    cols = feature_panel_columns()
    x = build_xcols(cols, TRANSITIONS[0].tokens, TRANSITIONS[0].always)
    assert not any(c.startswith(("spr_", "dir_")) for c in x) and "PriceImbalance" not in x and "idx" not in x
    assert "wind_revision_IDA1_DAM" in x
    strict = build_xcols(cols, TRANSITIONS[0].tokens, TRANSITIONS[0].always, strict_gate_horizon="DAM")
    assert "wind_revision_IDA1_DAM" not in strict


def test_live_feature_columns_match_static(spark):
    from spreadforge.plans.catalog import features
    live = features(spark, "/root/testdata/sf0.001").columns
    assert sorted(live) == sorted(feature_panel_columns())
