"""Single events: parsing, every matcher, arrays, the registry."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evmatch import InvalidJson, InvalidPattern, PatternSet, TypedFlattener, UnsupportedMediaType, ValueMatcher
from evmatch.functions import casefold, numbits
from evmatch.operators import local
from evmatch.plans.pattern import number_text, parse


def hit(pattern, event, **options):
    event = event if isinstance(event, str) else json.dumps(event)
    return PatternSet.of({"x": pattern}, **options).has_matches(event)


@pytest.mark.parametrize("token", ["72", "72.0", "7.2e1", "72.0000", "0.0072E4"])
def test_numbers_are_equal_in_any_form(token):
    assert hit({"x": [72]}, f'{{"x":{token}}}')


@pytest.mark.parametrize(
    ("matcher", "yes", "no"),
    [
        ("a", ["a"], ["b", 1, None, []]),
        (72, [72, "72", 72.0], ["72.0", 73]),
        ("true", [True, "true"], [False]),
        (None, [None, "null"], [0]),
        ({"exists": True}, [0, None, "", False, [1]], [[], {}]),
        ({"exists": False}, [[], {}], [0, None]),
        ({"prefix": "qu"}, ["qu", "quay"], ["q", "uq"]),
        ({"prefix": ""}, ["", "x", 1], []),
        ({"prefix": "7"}, [72, "7"], [2]),
        ({"suffix": "ay"}, ["quay", "ay"], ["ayq"]),
        ({"suffix": "a*"}, ["xa*"], ["xab"]),
        ({"wildcard": "*"}, ["", "tide", "*"], []),
        ({"wildcard": "a*b*c"}, ["abc", "axxbxxc"], ["ab", "acb"]),
        ({"wildcard": "a\\*b"}, ["a*b"], ["axb"]),
        ({"wildcard": "a\\\\b"}, ["a\\b"], ["ab"]),
        ({"wildcard": "ab*ab"}, ["abab", "abxab"], ["ab"]),
        ({"shellstyle": "a\\*b"}, ["a\\xb"], ["a*b"]),
        ({"anything-but": "a"}, ["b", 1], ["a"]),
        ({"anything-but": ["ebb", "flood"]}, ["slack"], ["ebb", "flood"]),
        ({"anything-but": [""]}, ["x"], [""]),
        ({"anything-but": 12}, [7, "text", "12"], [12, 12.0]),
        ({"equals-ignore-case": "Buoy"}, ["buoy", "BUOY", "bUoY"], ["buoys"]),
        ({"equals-ignore-case": "k"}, ["k", "K"], ["K"]),
        ({"equals-ignore-case": "K"}, ["k", "K"], ["K"]),
        ({"equals-ignore-case": "ß"}, ["ß"], ["ss", "SS"]),
        ({"equals-ignore-case": "ς"}, ["ς", "σ"], ["Σ"]),
        ({"numeric": [">", 6]}, [9, 6.25], [6, 2, 0, "9", ""]),
        ({"numeric": [">=", -4, "<=", 9]}, [3, -4, 9], [10, -5]),
        ({"numeric": ["=", 3]}, [3, 3.0], [4]),
        ({"numeric": []}, [], [1, 0]),
        ({"numeric": [">=", 0.0002, "<=", 0.02]}, [7.7e-4, 2e-3], [0.2]),
        ({"cidr": "192.168.40.9/26"}, ["192.168.40.0", "192.168.40.63"], ["192.168.40.64", "192.168.40", "192.300.40.1", "192.168.40.07"]),
        ({"cidr": "0.0.0.0/0"}, ["1.2.3.4"], ["x"]),
        ({"cidr": "fd00:77::/32"}, ["fd00:77:0:0:0:0:0:5", "FD00:77:ab:cd:9:8:7:6"], ["fd00:78:0:0:0:0:0:5", "fd00:77::5"]),
        ({"regexp": "[P-T]{2}/[4-8]{4}"}, ["RQ/4785"], ["pier", "xRQ/4785", "RQ/4785\n"]),
        ({"regex": "berth~.[0-9]+"}, ["berth.12"], ["berthX12"]),
        ({"regexp": ""}, [""], ["tide"]),
        ({"regexp": "a|"}, ["a", ""], ["b"]),
        ({"regexp": "^a$"}, ["^a$"], ["a"]),
        ({"regexp": "a.c"}, ["a\nc", "a\U0001f600c"], ["ac"]),
        ({"regexp": "(ab)+?c*"}, ["ab", "ababcc"], ["a"]),
        ({"regexp": "a{2,}"}, ["aa", "a" * 150], ["a"]),
        ({"regexp": "[^a-c]"}, ["d", "é"], ["a"]),
        ({"regexp": "[-a]+"}, ["-a-"], ["b"]),
        ({"regexp": "~d~w~s~D~W~S"}, ["1_ a-b"], ["1_ 1-b"]),
        ({"regexp": "~i~c*"}, ["_a-1", "é"], ["1a"]),
        ({"regexp": "~p{Lu}~P{Lu}"}, ["Ab"], ["AB"]),
        ({"regexp": "~p{IsCyrillic}+"}, ["Ж"], ["Z"]),
        ({"regexp": "[~p{Nd}~-]+"}, ["1-2"], ["a"]),
        ({"regexp": "~(~)~*~+~?~[~]~{~}~|~~~n"}, ["()*+?[]{}|~\n"], ["x"]),
        ({"regexp": "dry(?=dock)"}, ["drydock"], ["dry", "dryland"]),
        ({"regexp": "dry(?!dock)"}, ["dryland", "other"], ["drydock"]),
        ({"regexp": "(?<=dry)dock"}, ["drydock"], ["wetdock"]),
        ({"regexp": "(?<!dry)dock"}, ["wetdock"], ["drydock"]),
    ],
)
def test_matchers(matcher, yes, no):
    for value in yes:
        assert hit({"v": [matcher]}, {"v": value}), (matcher, value)
    for value in no:
        assert not hit({"v": [matcher]}, {"v": value}), (matcher, value)


def test_strict_lookaround_wants_the_primary_too():
    assert hit({"v": [{"regexp": "dry(?!dock)"}]}, {"v": "dryland"}, strict_lookaround=True)
    assert not hit({"v": [{"regexp": "dry(?!dock)"}]}, {"v": "other"}, strict_lookaround=True)


@pytest.mark.parametrize(
    "bad",
    [
        {"x": 1}, {"x": "a"}, {"x": [{"unknown": 1}]}, {"x": [{}]}, {"x": [[1]]}, {"x": [{"exists": 1}]}, {"x": [{"prefix": 1}]},
        {"x": [{"wildcard": "a**b"}]}, {"x": [{"wildcard": "a\\b"}]}, {"x": [{"wildcard": "a\\"}]}, {"x": [{"shellstyle": "**"}]},
        {"x": [{"anything-but": ["a", 1]}]}, {"x": [{"anything-but": []}]}, {"x": [{"anything-but": [True, None]}]},
        {"x": [{"numeric": [">"]}]}, {"x": [{"numeric": ["!", 1]}]}, {"x": [{"numeric": [">", "1"]}]},
        {"x": [{"cidr": "172.16.0.0/40"}]}, {"x": [{"cidr": "fd00::/130"}]}, {"x": [{"cidr": "172.16.0.0"}]}, {"x": [{"cidr": "the.third.pier/8"}]},
        {"x": [{"regexp": "(.)~1"}]}, {"x": [{"regexp": "(?=(?=a)b)c"}]}, {"x": [{"regexp": "(?<=a+)b"}]}, {"x": [{"regexp": "(a"}]},
        {"x": [{"regexp": "a)"}]}, {"x": [{"regexp": "[a"}]}, {"x": [{"regexp": "*a"}]}, {"x": [{"regexp": "a]"}]}, {"x": [{"regexp": "[a-[b]]"}]},
        {"x": [{"regexp": "~b"}]}, {"x": [{"regexp": "(?<n>a)"}]}, {"x": [{"regexp": "~p{Xx}"}]}, {"x": [{"regexp": "a{3,2}"}]},
    ],
)
def test_bad_patterns(bad):
    with pytest.raises(InvalidPattern):
        parse(bad)


@pytest.mark.parametrize("bad", ["", "{", '{"a":[1]', "[1", '{"a" 1}'])
def test_patterns_that_are_no_json(bad):
    with pytest.raises(InvalidJson):
        parse(bad)


@pytest.mark.parametrize("bad", ["", "[1]", '"x"', '{"a":1', '{"a":01}', '{"a":1,}', '{"a":"\x01"}', '{"a":"\\q"}', '{"a":tru}', '{"a":1} x', '{"a":NaN}', b'{"a":"\xff"}'])
def test_bad_events(bad):
    with pytest.raises(InvalidJson):
        PatternSet.of({"x": {"a": [1]}}).matches_for_event(bad)


HARBOUR = {
    "piers": [
        {"label": "north", "berths": [{"ship": "Petrel", "cargo": ["timber", "wool"]}, {"ship": "Auk", "cargo": ["salt"]}]},
        {"label": "south", "berths": [{"ship": "Tern", "flag": "NO"}, {"ship": "Gannet", "flag": "IS"}]},
    ]
}
HARBOUR_PATTERNS = {
    "yes": {"piers": {"berths": {"ship": ["Petrel"], "cargo": ["wool"]}}},
    "other berth": {"piers": {"berths": {"ship": ["Tern"], "flag": ["IS"]}}},
    "other cargo": {"piers": {"berths": {"ship": ["Petrel"], "cargo": ["salt"]}}},
    "other pier": {"piers": {"label": ["north"], "berths": {"ship": ["Gannet"]}}},
    "two levels": {"piers": {"label": ["south"], "berths": {"flag": ["NO", "x"], "ship": [{"prefix": "T"}]}}},
}


def test_values_come_from_one_array_element():
    assert sorted(PatternSet.of(HARBOUR_PATTERNS).matches_for_event(json.dumps(HARBOUR))) == ["two levels", "yes"]


def test_nested_arrays_and_repeated_keys():
    assert hit({"a": ["x"]}, {"a": [["y"], [["x"]]]})
    assert hit({"a": [1]}, '{"a":2,"a":1}')
    assert not hit({"a": ["x"]}, {"a": [{"a": "x"}]})
    assert hit({"a.b": [1]}, {"a.b": 1}) and not hit({"a.b": [1]}, {"a": {"b": 1}})


@pytest.mark.parametrize("field", ["a", "b", "c"])
def test_missing_fields_in_any_place(field):
    pattern = {k: [{"exists": False}] if k == field else ["v"] for k in "abc"}
    assert hit(pattern, {k: "v" for k in "abc" if k != field})
    assert not hit(pattern, {k: "v" for k in "abc"})


def test_combinations():
    assert not hit({}, {"a": 1})
    assert hit({"a": [], "b": [1]}, {"b": 1})
    assert hit({"a": [{"exists": False}, "x"]}, {"a": "x"}) and hit({"a": [{"exists": False}, "x"]}, {"b": 1})
    assert hit('{"a":[1],"a":[2]}', {"a": 2}) and not hit('{"a":[1],"a":[2]}', {"a": 1})
    assert hit({"v": [{"prefix": "a", "suffix": "z"}]}, {"v": "ab"})  # the first key is the operator
    assert hit({"x": ["\U0001f600"]}, '{"x":"\\ud83d\\ude00"}') and hit({"x": ["ab"]}, '{"x":"a\\ud83db"}')


def test_registry():
    patterns = PatternSet.of({"a": [{"s": ["x"]}, {"t": [1]}], "b": {"s": ["x"]}})
    assert patterns.matches_for_event('{"s":"x","t":1}') == ["a", "b"]
    assert patterns.count_matches('{"s":"x"}') == 2 and patterns.flatten_only('{"s":["x","y"],"t":1,"u":2}') == 3
    before = patterns.clone()
    patterns.delete_patterns("a")
    patterns.delete_patterns("unknown")
    assert patterns.matches_for_event('{"s":"x"}') == ["b"] and patterns.pattern_ids() == ["b"]
    assert before.matches_for_event('{"s":"x"}') == ["a", "b"] and not patterns.contains_pattern("a")
    patterns.add_pattern("a", {"u": [1]})
    assert patterns.matches_for_event('{"t":1}') == [] and patterns.matches_for_event('{"u":1}') == ["a"]
    assert patterns.rebuild() == 2 and patterns.pattern_count() == 2
    patterns.clear()
    assert patterns.is_empty()


def test_rebuild_rule():
    patterns = PatternSet.of({"a": {"s": ["x"]}, "b": {"s": ["x"]}})
    patterns.delete_patterns("a")
    for _ in range(499):
        patterns.matches_for_event('{"s":"x"}')
    assert not patterns.should_rebuild()
    patterns.matches_for_event('{"s":"x"}')
    assert patterns.pruner_stats().emitted == 500 and patterns.pruner_stats().filtered == 500 and patterns.should_rebuild()
    patterns.auto_rebuild = False
    assert patterns.maybe_rebuild() == 0
    patterns.auto_rebuild = True
    assert patterns.maybe_rebuild() == 1 and patterns.pruner_stats().emitted == 0


def test_builder():
    assert PatternSet.builder().with_media_type("application/json").with_auto_rebuild(False).build().auto_rebuild is False
    flat = TypedFlattener()
    assert PatternSet.builder().with_flattener(flat).build().flattener is flat
    for wrong in (
        lambda: PatternSet.builder().with_media_type("text/xml"),
        lambda: PatternSet.builder().with_media_type("application/json").with_flattener(flat),
        lambda: PatternSet.builder().with_flattener(flat).with_media_type("application/json"),
        lambda: PatternSet.builder().with_flattener(flat).with_flattener(flat),
    ):
        with pytest.raises(UnsupportedMediaType):
            wrong()


def test_value_matcher():
    values = ValueMatcher().add_string("s", "quay").add_prefix("p", "qu").add_shellstyle("g", "q*y")
    assert values.matches("quay") == ["s", "p", "g"] and values.matches("quit") == ["p"]


@given(st.floats(allow_nan=False, allow_infinity=False), st.floats(allow_nan=False, allow_infinity=False))
def test_number_keys_keep_the_order(x, y):
    x, y = x + 0.0, y + 0.0
    assert (numbits.to_key(x) < numbits.to_key(y)) == (x < y)
    assert float(numbits.key_to_text(numbits.to_key(x))) == x


def test_small_helpers():
    assert [number_text(x) for x in (35.0, 1e21, 0.5, 1e-7)] == ["35", "1000000000000000000000", "0.5", "0.0000001"]
    assert [casefold.partner(c) for c in "aAß1İ\U00010c80"] == ["A", "a", None, None, None, "\U00010cc0"]


@settings(max_examples=200, deadline=None)
@given(st.text("ab*\\", max_size=6), st.text("ab*\\", max_size=8))
def test_wildcards_agree_with_their_regex(pattern, value):
    import regex

    from evmatch.functions import wildcard
    from evmatch.functions.iregexp import for_python

    try:
        parts = wildcard.pieces(pattern, True)
    except InvalidPattern:
        return
    assert wildcard.matches(value, parts) == bool(regex.search(for_python(wildcard.to_regex(parts)), value))


def test_leaves_keep_tokens_and_trails():
    found = local.leaves('{"a":[1.50,{"b":"x"}],"c":null}', [("a",), ("a", "b"), ("c",)])
    assert [x.v for x in found["a",]] == ["1.50"] and found["a", "b"][0].trail == ((("/0"), 1),) and found["c",][0].v == "null"


def test_an_event_is_read_once_for_several_questions(monkeypatch):
    from evmatch.operators import local

    reads, read = [], local.read
    monkeypatch.setattr(local, "read", lambda event: reads.append(event) or read(event))
    patterns = PatternSet.of({"a": {"x": [1]}})
    event = '{"x":1,"y":"a"}'
    assert patterns.matches_for_event(event) == ["a"] and patterns.has_matches(event) and patterns.flatten_only(event) == 1 and len(reads) == 1
    patterns.add_pattern("b", {"y": ["a"]})
    assert patterns.matches_for_event(event) == ["a", "b"] and len(reads) == 2
    clone = patterns.clone()
    patterns.delete_patterns("a")
    assert patterns.matches_for_event(event) == ["b"] and clone.matches_for_event(event) == ["a", "b"]
    with pytest.raises(InvalidJson):
        patterns.matches_for_event("{")
    with pytest.raises(InvalidJson):
        patterns.matches_for_event("{")
