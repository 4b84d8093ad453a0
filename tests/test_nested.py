import json

from leadloom.operators import nested

SCHEMA = "page_id long, source_platform string, payload string, kind string, child_pos string"


def pages(spark, *rows):
    return spark.createDataFrame([(i, p, x, "clash", "clash") for i, (p, x) in enumerate(rows)], SCHEMA)


def found(spark, *rows):
    return sorted(tuple(r) for r in nested.children_with_text(pages(spark, *rows)).select("page_id", "posting_pos", "kind", "child_pos").collect())


def test_children_keep_their_places(spark):
    jobs = {"jobs": [None, 7, "see careers page", {"id": 1, "offices": [None, {"location": "Paris"}, {"location": {"name": "Rome"}}, {"location": "  　"}, {"location": None}]}]}
    assert found(spark, ("greenhouse", json.dumps(jobs))) == [(0, 3, "office", 1), (0, 3, "office", 2)]


def test_single_objects_strings_and_wrappers(spark):
    one = {"id": 1, "offices": {"location": "Lyon"}}
    held = {"id": 2, "locations": json.dumps([{"country": {"name": "Chile"}}, {"country": ["x"]}])}
    assert found(
        spark,
        ("greenhouse", "﻿" + json.dumps({"response": {"data": {"jobs": one}, "ok": True}})),
        ("workable", json.dumps(json.dumps({"jobs": [held]}))),
        ("lever", json.dumps({"id": "a", "text": "t", "lists": [{"content": "<li>x</li>"}]})),
    ) == [(0, 0, "office", 0), (1, 0, "location", 0), (2, 0, "list", 0)]


def test_full_location_only_on_its_platform(spark):
    page = json.dumps({"content": [{"location": {"fullLocation": "Oslo, Norway"}}, {"location": [{"fullLocation": "Bonn"}]}, {"location": []}]})
    assert found(spark, ("smartrecruiters", page), ("workable", page)) == [(0, 0, "full_location", 0), (0, 1, "full_location", 0)]


def test_unreadable_payloads_hold_nothing(spark):
    whole = json.dumps({"jobs": [{"offices": [{"location": "A"}]}]})
    assert found(spark, ("greenhouse", None), ("greenhouse", ""), ("greenhouse", whole[:-3]), ("greenhouse", "<html></html>"), ("greenhouse", whole + " tail"), ("greenhouse", '{"error": 1}')) == []
    assert nested.children(pages(spark).limit(0)).count() == 0


def test_children_belong_to_postings(spark):
    page = pages(spark, ("lever", json.dumps([{"id": "x", "text": "Dev", "lists": [{"content": "a"}, {"text": "b"}]}, 3])))
    postings = nested.postings(page).collect()
    assert [(r.posting_pos, r.external_id, r.title, r.is_posting) for r in postings] == [(0, "x", "Dev", True), (1, None, None, False)]
    assert {(r.posting_pos, r.child_pos, r.child_text) for r in nested.children(page).filter("kind = 'list'").collect()} == {(0, 0, "a"), (0, 1, None)}


def held(value, times):
    for _ in range(times):
        value = json.dumps(value)
    return value


def test_wrappers_and_strings_of_any_depth(spark):
    deep = whole = {"jobs": [{"offices": held([{"location": "A"}], 5)}]}
    for i in range(9):
        deep = {nested.WRAPPERS[i % 5]: deep}
    mixed = held({"response": held({"data": held(whole, 3)}, 2)}, 4)
    assert found(spark, ("greenhouse", json.dumps(deep)), ("lever", mixed)) == [(0, 0, "office", 0), (1, 0, "office", 0)]


def test_text_behind_a_value_makes_it_incomplete(spark):
    whole = json.dumps({"jobs": [{"offices": [{"location": "A"}]}]})
    assert found(spark, *[("greenhouse", whole + tail) for tail in ('{"b":1}', "] [{}", ',{"b":1}', "}", " null")]) == []
    held_text = json.dumps({"jobs": [{"offices": [{"location": "[1] Berlin"}, {"location": '{"name": "x"} y'}]}]})
    assert [r.child_text for r in nested.children(pages(spark, ("lever", held_text))).collect()] == ["[1] Berlin", '{"name": "x"} y']


def test_last_of_repeated_keys_counts(spark):
    page = pages(spark, ("lever", '[{"lists": [{"content": "a", "content": "b"}]}]'))
    assert [r.child_text for r in nested.children(page).collect()] == ["b"]
