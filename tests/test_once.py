"""What is costly a row is computed once a row, whatever is asked of it."""

import pytest
from statuta.plans import catalog

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["lex_action", "lex_actor", "lex_condition", "lex_constraint", "lex_exception"])
def test_a_filter_on_a_field_does_not_extract_again(spark, name):
    filters = [x for x in plan(catalog.QUERIES[name](spark, DATA)).splitlines() if "Filter" in x]
    assert filters and not any("lambdafunction" in x for x in filters)


@pytest.mark.parametrize("name", ["lanes", "activities", "bpmn_scan", "model_files", "model_files_apart"])
def test_a_model_is_parsed_once(spark, name):
    assert plan(catalog.QUERIES[name](spark, DATA)).count("from_xml(") == 1


def test_clauses_are_found_once_for_all_fields(spark):
    assert plan(catalog.QUERIES["flatten_prediction"](spark, DATA)).count("no person shall|") == 2
