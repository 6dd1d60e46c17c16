"""Registered queries against their SQL; the full list runs with ``python -m tests.oracle``."""

import os

import pytest

from tests.oracle import compare, connect
from wardframe.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
CORE = (
    "cohort_sizes", "dx_union_procedures", "chart_unit_convert", "input_events_mv", "vent_events", "dose_to_mg",
    "first_lab", "item_discovery", "note_collapse", "note_datetime_repair", "note_echo_vitals", "note_infusions",
    "note_medications", "note_biomarkers_flowsheet", "note_discharge_biomarkers", "note_nutrition_labs",
    "note_troponin_all", "bucket4_mean", "minmax_scale", "edge_pad", "training_examples", "amputate_mask",
    "fold_assign", "impute_linear", "impute_random", "impute_em", "masked_metrics", "bootstrap_ci",
    "feature_box_stats", "mmd_scalar", "dilate", "roc_auc", "vector_roundtrip",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, QUERIES[name], ORACLES[name], SF) == ""


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
