"""Configuration: YAML entries, blocks of ConfigMaps, placeholders to their ends, lanes."""

import pytest

from factloom.sources import config

YAML = """# head
server: {port: 1}
spring:
  profiles:
    active: qa # the lane
  "quoted.key": 'it''s'
kafka:
  topics:
    - name: A
      tags: [x, "y, z"]
    - name: B
  brokers:
  - one
  - two # second
url: http://host:80/a#b
empty: ""
none:
text: |
  line: one

  two
folded: >-
  a
  b
plain: "a \\"b\\""
---
second: 1
kafka:
  other: true
"""


def test_yaml():
    got = dict(config.read_yaml(YAML))
    assert got == {
        "server": "{port: 1}", "spring.profiles.active": "qa", "spring.quoted.key": "it's", "kafka.topics[0].name": "A", "kafka.topics[0].tags": "[x, y, z]", "kafka.topics[0].tags[0]": "x",
        "kafka.topics[0].tags[1]": "y, z", "kafka.topics[1].name": "B", "kafka.brokers[0]": "one", "kafka.brokers[1]": "two", "kafka.brokers": "[one, two]", "url": "http://host:80/a#b", "empty": "",
        "text": "line: one\n\ntwo", "folded": "a b", "plain": 'a "b"', "second": "1", "kafka.other": "true",
    }


@pytest.mark.parametrize("text", ["", "\n\n", "just text", "- a\n- b", "a: [", "\t: x", ":", "a: b: c", "- - x\n  - y", "a:\n    b: 1\n  c: 2", "'", "k: |", "x: 'open"])
def test_odd_yaml_is_read_without_error(text):
    assert all(isinstance(k, str) and isinstance(v, str) for k, v in config.read_yaml(text))


def rows(spark, files):
    return spark.createDataFrame(files, "path string, text string")


MAP = "kind: ConfigMap\nmetadata:\n  name: order-dev-config\ndata:\n  application-pdn.yaml: |\n    a: 1\n    b:\n      c: ${a}\n  plain: text\n  note: |\n    no yaml\n    here\n"


def test_blocks_of_config_maps(spark):
    got = {(r.source, r.key, r.value) for r in config.config_entries(rows(spark, [("k/m.yaml", MAP), ("x.txt", "a: 1"), ("n.yml", None), ("d.yml", "a: 1\na: 2")])).collect()}
    assert {x for x in got if "#" in x[0]} == {("k/m.yaml#application-pdn.yaml", "a", "1"), ("k/m.yaml#application-pdn.yaml", "b.c", "${a}")}
    assert ("k/m.yaml", "metadata.name", "order-dev-config") in got and ("k/m.yaml", "data.plain", "text") in got and ("d.yml", "a", "2") in got and not any(x[0] in ("x.txt", "n.yml") for x in got)


def test_placeholders(spark):
    values = {
        "a": "1", "b": "${a}-${a}", "c": "x${b}y", "d": "${lost:${c}}", "e": "${lost}", "f": "${f}", "g": "${h}", "h": "${g:1}", "i": "${g}/${a}", "j": "${lost:}", "k": "${a:9}", "l": "${lost:http://h:80}", "m": "$ {a} }{",
        "n": "${ a }", "o": "${d}${e}",
    }
    df = spark.createDataFrame([("s", k, v) for k, v in values.items()] + [("t", "a", "2"), ("t", "b", "${a}${c}"), ("t", "z", None)], "scope string, key string, value string")
    got = {(r.scope, r.key): r.value for r in config.filled(df, ["scope"]).collect()}
    want = {
        "a": "1", "b": "1-1", "c": "x1-1y", "d": "x1-1y", "e": "${lost}", "f": "${f}", "g": "${h}", "h": "${g:1}", "i": "${g}/1", "j": "", "k": "1", "l": "http://h:80", "m": "$ {a} }{", "n": "1", "o": "x1-1y${lost}",
    }
    assert got == {("s", k): v for k, v in want.items()} | {("t", "a"): "2", ("t", "b"): "2${c}", ("t", "z"): ""}


def test_lanes(spark):
    files = rows(spark, [("m/src/main/resources/application-qa.yaml", "a: 1"), ("k/prod/x.yaml", "a: 1"), ("k/m.yaml", MAP), ("p/application.yml", "spring:\n  profiles:\n    active: dev,x"), ("q/application.yml", "a: 1"), ("r/c.yaml", MAP.replace("-pdn", ""))])
    got = {r.source: r.env_lane for r in config.lanes(files, config.config_entries(files)).collect()}
    assert got == {
        "m/src/main/resources/application-qa.yaml": "qa", "k/prod/x.yaml": "prod", "k/m.yaml": "dev", "k/m.yaml#application-pdn.yaml": "pdn", "p/application.yml": "dev", "q/application.yml": "unknown",
        "r/c.yaml": "dev", "r/c.yaml#application.yaml": "dev",
    }
