from docloom.operators import profiles


def test_profile_violations(spark):
    p = spark.createDataFrame([("good", "approved", "A", "2020-01-01"), ("bad", "approved", None, None), ("draft", "draft", None, None)], "profile_id string, approval_status string, approved_by string, approved_at string")
    s = spark.createDataFrame([("good", "s1"), ("bad", "s1"), ("bad", "s1")], "profile_id string, id string")
    r = spark.createDataFrame(
        [("good", "r1", "paragraph_role", ["s1"], "approved", "automatic"), ("bad", "r1", "table_role", ["s1", "s9"], "approved", "manual"), ("draft", "r2", "nowhere", [], "proposed", "automatic")],
        "profile_id string, id string, selector_kind string, source_ids array<string>, status string, application string",
    )
    props = spark.createDataFrame([("good", "r1", "bold", "true"), ("bad", "r1", "bold", "true"), ("bad", "r1", "table_style", "x"), ("draft", "r2", "bold", "x")], "profile_id string, rule_id string, key string, value string")
    c = spark.createDataFrame([("bad", "c1", ["r1", "r7"], "open"), ("draft", "c2", [], "open")], "profile_id string, id string, rule_ids array<string>, status string")
    found = profiles.profile_violations(p, s, r, props, c, profiles.allowed_properties(spark)).collect()
    assert sorted(map(tuple, found)) == [
        ("bad", "approval_without_a_name"), ("bad", "duplicate_source:s1"), ("bad", "open_conflict:c1"), ("bad", "unknown_rule:r7"), ("bad", "unknown_source:s9"), ("bad", "unsupported:r1.bold"), ("draft", "unsupported:r2.bold"),
    ]
    auto, review = profiles.automatic(r)
    assert [x.profile_id for x in auto.collect()] == ["good"] and review.count() == 2
    lines = {x.summary for x in profiles.summary(r.where("profile_id = 'bad'"), props.where("profile_id = 'bad'")).collect()}
    assert lines == {"r1: bold=true, table_style=x. Sources: s1, s9"}


def test_caption_violations(spark):
    cols = "entry_id int, approved boolean, action string, identifier_sha256 string, replacement_identifier string, title_text_sha256 string, hierarchy string, sequence string, text_sha256 string"
    df = spark.createDataFrame(
        [(1, True, "preserve", None, None, None, None, None, "h"), (2, True, "replace_identifier", "a", None, "t", None, None, "h"), (3, False, "replace_identifier", None, None, None, None, None, None), (4, True, "convert_to_seq", None, None, None, "1.1", None, "h"), (5, True, "other", None, None, None, None, None, "h")],
        cols,
    )
    assert sorted(map(tuple, profiles.caption_violations(df).collect())) == [(2, "replacement_incomplete"), (3, "no_hash"), (4, "sequence_incomplete"), (5, "unknown_action")]
