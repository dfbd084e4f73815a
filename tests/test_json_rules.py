"""
documents. Shapes whose handling differs on purpose (explicit nulls, booleans,
floats, duplicate keys, ids that are objects — README "Differences") are not
generated."""

import json
import random

from shoplens.functions.jsoncols import explode_regions, explode_store_ids


def _value(rnd, depth=0):
    kind = rnd.choice(["int", "str", "obj", "list", "emptystr"] if depth < 2 else ["int", "str"])
    if kind == "int":
        return rnd.randint(0, 999)
    if kind == "str":
        return rnd.choice(["a", "x1", "17", "Shop 5", "名"])
    if kind == "emptystr":
        return ""
    if kind == "list":
        return [_value(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]
    return _obj(rnd, depth + 1)


def _obj(rnd, depth):
    keys = rnd.sample(["shop_id", "x", "regions", "city", "regionName", "district"], rnd.randint(0, 3))
    # a shop_id holding an object or list is a documented difference (JSON text vs Python repr)
    return {k: (rnd.choice([rnd.randint(0, 99), "s7", ""]) if k == "shop_id" else _value(rnd, depth)) for k in keys}


def _stores_doc(rnd):
    roll = rnd.random()
    if roll < 0.1:
        return "not json"
    if roll < 0.2:
        return json.dumps(_obj(rnd, 1))                       # root is not a list
    elems = []
    for _ in range(rnd.randint(0, 5)):
        r = rnd.random()
        if r < 0.5:
            elems.append({"shop_id": rnd.choice([rnd.randint(1, 99), str(rnd.randint(1, 99)), ""]),
                          **({"x": 1} if rnd.random() < 0.3 else {})})
        else:
            elems.append(_value(rnd))
    return json.dumps(elems, ensure_ascii=False)


def _load(doc):
    try:
        return json.loads(doc)
    except ValueError:
        return None


def expected_store_ids(doc):
    """SURVEY G1: list root only; object elements only; the id is the text of
    ``shop_id`` (absent -> ''); empty ids are dropped."""
    root = _load(doc)
    if type(root) is not list:
        return []
    ids = (str(e["shop_id"]) if "shop_id" in e else "" for e in root if type(e) is dict)
    return [i for i in ids if i]


def _regions_doc(rnd):
    if rnd.random() < 0.1:
        return "{broken"
    doc = {}
    for i in range(rnd.randint(0, 4)):
        r = rnd.random()
        if r < 0.6:
            regions = {}
            for part in rnd.sample(["city", "district", "business"], rnd.randint(0, 3)):
                regions[part] = rnd.choice([{"regionName": rnd.choice(["Bj", "Cy", "7"])}, {"other": 1}, "text", 5])
            doc[str(i + rnd.randint(0, 50))] = {"regions": regions} if rnd.random() < 0.85 else {"other": 1}
        else:
            doc[str(100 + i)] = rnd.choice([5, "x", [1], {"regions": [1, 2]}, {"regions": "no"}])
    return json.dumps(doc, ensure_ascii=False)


def expected_regions(doc):
    """SURVEY G2/G3: object root; object values whose ``regions`` is absent or an
    object; each part's ``regionName`` as text, '' when missing or when the
    part is not an object."""
    root = _load(doc)
    if type(root) is not dict:
        return {}

    def name(regions, part):
        info = regions.get(part)
        return str(info["regionName"]) if type(info) is dict and "regionName" in info else ""

    return {str(k): tuple(name(v.get("regions", {}), p) for p in ("city", "district", "business"))
            for k, v in root.items() if type(v) is dict and type(v.get("regions", {})) is dict}


def test_store_ids_match_rule(spark):
    rnd = random.Random(21)
    docs = [_stores_doc(rnd) for _ in range(400)]
    df = spark.createDataFrame([(f"a{i:03d}", d) for i, d in enumerate(docs)], "account string, stores_json string")
    got = {}
    for r in explode_store_ids(df).orderBy("account", "pos").collect():
        got.setdefault(r.account, []).append(r.shop_id)
    for i, d in enumerate(docs):
        assert got.get(f"a{i:03d}", []) == expected_store_ids(d), d


def test_regions_match_rule(spark):
    rnd = random.Random(8)
    docs = [_regions_doc(rnd) for _ in range(300)]
    df = spark.createDataFrame([(f"a{i:03d}", d) for i, d in enumerate(docs)],
                               "account string, compareRegions_json string")
    got = {}
    for r in explode_regions(df).collect():
        got.setdefault(r.account, {})[r.shop_id] = (r.region_city, r.region_district, r.region_business)
    for i, d in enumerate(docs):
        assert got.get(f"a{i:03d}", {}) == expected_regions(d), d
