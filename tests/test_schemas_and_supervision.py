import json

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomspan.operators import supervision
from loomspan.sources import schemas


def plain(node, defs, prefix="", seen=()):
    """Fields by recursion."""
    out = []

    def look(n, seen):
        ref = n.get("$ref")
        return (n, seen) if ref is None else ({} if ref in seen else defs.get(ref, {}), (*seen, ref))

    node, seen = look(node, seen)
    for name, field in node.get("properties", {}).items():
        field, own = look(field, seen)
        path = f"{prefix}.{name}" if prefix else name
        out.append((path, name in node.get("required", [])))
        if field.get("properties"):
            out += plain(field, defs, path, own)
        if field.get("type") == "array":
            item, inner = look(field.get("items", {}), own)
            out += plain(item, defs, path + "[]", inner)
    return out


DEFS = {"#/d/leaf": {"type": "object", "required": ["x"], "properties": {"x": {"type": "number", "enum": [1, 2]}, "y": {}}}, "#/d/loop": {"properties": {"again": {"$ref": "#/d/loop"}, "leaf": {"$ref": "#/d/leaf"}}}}
DEEP = {"properties": {"n0": {"type": "string"}}}
for _depth in range(1, 8):
    DEEP = {"type": "object", "required": [f"n{_depth}"], "properties": {f"n{_depth}": DEEP}}


@pytest.mark.parametrize("spec", [
    {"type": "object", "required": ["b"], "properties": {"b": {"$ref": "#/d/leaf"}, "a": {"type": "array", "items": {"$ref": "#/d/leaf"}}, "c": {"type": "array", "items": {"type": "array"}}, "z": {"$ref": "#/none"}}},
    {"$ref": "#/d/loop"}, DEEP, {}, {"properties": {}}, {"type": "string"},
])
def test_fields_to_any_depth(spark, spec):
    df = spark.createDataFrame([(1, json.dumps(spec), {k: json.dumps(v) for k, v in DEFS.items()})], "id int, s string, refs map<string,string>")
    got = schemas.flattened(df, "id", "s", "refs").orderBy("place").collect()
    assert [(r.path, r.required) for r in got] == plain(spec, DEFS)
    assert schemas.flattened(df.limit(0), "id", "s", "refs").count() == 0


def test_types_and_descriptions(spark):
    spec = {"properties": {"a": {"anyOf": [{"type": "null"}, {"type": "string"}], "default": "x/y"}, "b": {"type": "array", "items": {"type": "string", "enum": ["p", "q"]}, "description": " list "}, "c": {"oneOf": []}, "d": {"properties": {}}, "e": {"type": "boolean", "default": False}}}
    df = spark.createDataFrame([(1, json.dumps(spec)), (2, None), (3, "no json")], "id int, s string")
    got = {r.path: (r.type, r.default, r.description) for r in schemas.flattened(df, "id", "s").collect()}
    assert got == {"a": ("null | string", "x/y", ""), "b": ("string[]", None, "list; one of p, q"), "c": ("any", None, ""), "d": ("object", None, ""), "e": ("boolean", "false", "")}


def test_supervised_tokens_equal_single_ones(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    cases = {1: [("user", "What is red?"), ("assistant", "It is a colour.")], 2: [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "é漢\U0001f600 d\n")], 3: [("system", "s")], 4: [("assistant", None)], 5: [(None, "x"), ("assistant", "y " * 400)]}
    rows = [(c, k, r, s) for c, turns in cases.items() for k, (r, s) in enumerate(turns)]
    df = spark.createDataFrame(rows, "case int, turn int, role string, text string")
    got = {r.case: r for r in supervision.supervision_audit(df.repartition(3), "case", "turn", "role", "text", path, 300).collect()}
    for c, turns in cases.items():
        whole, at, spans = "", 0, []
        for role, said in turns:
            head = f"<|im_start|>{role or ''}\n"
            spans += [(len(whole) + len(head), len(whole) + len(head) + len(said or "") + len("<|im_end|>"))] if role == "assistant" else []
            at = len(whole) + len(head)
            whole += f"{head}{said or ''}<|im_end|>\n"
        offsets = tok.encode(whole, add_special_tokens=False).offsets
        mask = [b > a and any(lo <= a and b <= hi for lo, hi in spans) for a, b in offsets]
        r = got[c]
        assert (r.tokens, r.supervised, r.prompt_tokens) == (len(offsets), sum(mask), sum(a < at for a, _ in offsets))
        assert r.spans == sum(m and not (i and mask[i - 1]) for i, m in enumerate(mask)) and r.within == (len(offsets) <= 300)
    assert got[1].ok and not got[2].ok and got[2].spans == 2 and not got[3].covered and got[3].spans == 0 and not got[5].within
    total = supervision.audit_summary(supervision.supervision_audit(df, "case", "turn", "role", "text", path, 300)).first()
    assert (total.cases, total.too_long, total.not_one_span) == (5, 1, 2)
    assert supervision.supervision_audit(df.limit(0), "case", "turn", "role", "text", path, 300).count() == 0
