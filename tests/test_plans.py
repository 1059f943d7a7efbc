"""The physical plans are the ones meant: few shuffles, early filters, no Python."""

from breezeline.operators import history, messages, responses, scoring, status
from breezeline.plans import catalog, inputs

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_shuffles_once(spark):
    text = plan(scoring.alerts(scoring.score(inputs.readings(spark, SF_DIR))))
    assert text.count("Exchange") == 1 and text.count("Window [") == 1
    assert "Python" not in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in text


def test_ranks_filter_before_the_shuffle(spark):
    rows = inputs.readings(spark, SF_DIR)
    for df in (
        status.city_status(rows),
        history.keep_first(rows),
        history.latest_history(history.to_history(rows)),
    ):
        assert "row_number(), " in plan(df) and "Partial" in plan(df)
        assert plan(df).count("Exchange") == 1


def test_lookups_push_their_filter_down(spark, tmp_path):
    path = str(tmp_path / "h")
    history.to_history(inputs.readings(spark, SF_DIR)).write.parquet(path)
    text = plan(history.city_history(spark.read.parquet(path), "7"))
    assert "EqualTo(city,7)" in text and "TakeOrderedAndProject" in text


def test_row_wise_work_does_not_shuffle(spark):
    classified = responses.events(responses.classify(inputs.responses(spark, SF_DIR)))
    decoded = messages.readings(messages.decode(inputs.records(spark, SF_DIR)))
    for df in (classified, decoded, messages.encode(inputs.readings(spark, SF_DIR))):
        assert "Exchange" not in plan(df) and "Python" not in plan(df)


def test_a_body_is_parsed_once(spark):
    df = responses.events(responses.classify(inputs.responses(spark, SF_DIR)))
    assert plan(df).count("parseJson") == 1


def test_small_registry_is_broadcast(spark):
    text = plan(catalog.registry_semi_join(spark, SF_DIR))
    assert "BroadcastHashJoin" in text and "LeftSemi" in text


def test_wide_status_cuts_a_hot_city_before_the_last_shuffle(spark):
    text = plan(status.city_status(inputs.readings(spark, SF_DIR), size=1500))
    assert "hashpartitioning(city#" in text and "_salt#" in text
    # read from the bottom: shuffle by city and salt, rank, filter, then shuffle by city
    order = text.splitlines()[::-1]
    shuffles = [i for i, line in enumerate(order) if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 2 and "_salt" in order[shuffles[0]] and "_salt" not in order[shuffles[1]]
    assert any("Filter" in line and "1500" in line for line in order[shuffles[0] : shuffles[1]])
