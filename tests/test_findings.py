"""Findings and their evidence."""

import pytest

from loomgraph.operators import architecture, findings

NODES = "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, language string, role string"


def node(path, name, role, line=1):
    ref = f"{path}::{name}"
    return (f"symbol:{ref}", "class", name, ref, path, line, line + 3, "java", role)


@pytest.fixture(scope="module")
def nodes(spark):
    files = [f"app/{d}/F{i}.java" for d in ("controllers", "services", "repository", "odd") for i in range(8)]
    rows = [(f"file:{p}", "file", p.rsplit("/", 1)[-1], p, p, None, None, "java", "unknown") for p in files]
    rows += [node("app/controllers/F0.java", "AController", "controller"), node("app/services/F0.java", "AService", "service"), node("app/repository/F1.java", "ARepository", "repository"), node("app/odd/F1.java", "KafkaListener", "mq"), node("app/odd/F2.java", "Thing", "unknown")]
    return spark.createDataFrame(rows, NODES)


@pytest.fixture(scope="module")
def edges(spark):
    c, s, r, t = ("app/controllers/F0.java::AController", "app/services/F0.java::AService", "app/repository/F1.java::ARepository", "app/odd/F2.java::Thing")
    rows = [(c, s, "call", 5), (s, r, "call", None), (r, c, "call", 9), (t, c, "call", 1), (c, t, "import", 1)]
    return spark.createDataFrame(rows, "source string, target string, edge_type string, line int")


def ranked(spark, pattern, score=0.8):
    return spark.createDataFrame([(pattern, score, 1, True), ("other", 0.1, 2, False)], "pattern string, score double, rank int, primary boolean")


def test_layer_samples(nodes, edges):
    got = [(r.evidence.note, r.evidence.start_line) for r in findings.layer_samples(edges, nodes).orderBy("pos").collect()]
    assert got == [("downward controller->service", 5), ("upward repository->controller", 9), ("downward service->repository", None)]
    assert findings.layer_samples(edges, nodes, 1).count() == 1


def test_boundaries(spark, nodes):
    got = {r.finding_id: r for r in findings.boundary_findings(architecture.modules(nodes), nodes).collect()}
    assert any("controllers" in k for k in got) and not any("odd" in k for k in got)
    for r in got.values():
        assert 0 < len(r.evidence) <= findings.OF_MODULE
        assert [e.file_path for e in r.evidence] == sorted(e.file_path for e in r.evidence)
    assert findings.boundary_findings(architecture.modules(nodes.limit(0)), nodes.limit(0)).count() == 0


def test_patterns(spark, nodes, edges):
    one = findings.pattern_findings(ranked(spark, "layered"), nodes, edges).first()
    assert one.finding_id == "pattern-layered" and one.confidence == "high"
    assert [e.note for e in one.evidence] == ["downward controller->service", "upward repository->controller", "downward service->repository", "role:controller", "role:service", "role:repository"]
    two = findings.pattern_findings(ranked(spark, "event_driven", 0.5), nodes, edges).first()
    assert [e.note for e in two.evidence] == ["role:mq", "message name"] and two.confidence == "medium"
    plain = nodes.where("role = 'unknown'")
    bare = findings.pattern_findings(ranked(spark, "mvc"), plain, edges).first()
    assert bare.confidence == "low" and [e.note for e in bare.evidence] == ["fallback"]
    assert findings.pattern_findings(ranked(spark, "mvc").where("not primary"), nodes, edges).count() == 0
    assert findings.pattern_findings(ranked(spark, "mvc"), nodes.limit(0), edges).count() == 0


def test_profile(spark, nodes):
    kind = "name string, kind string, file_path string"
    some, none = spark.createDataFrame([("Spring Boot", "java", "pom.xml"), ("Nowhere", "x", None)], kind), spark.createDataFrame([], kind)
    languages = spark.createDataFrame([("java", 32)], "language string, n long")
    got = [(r.finding_id, r.evidence[0].file_path) for r in findings.profile_findings(some, none, languages, nodes).collect()]
    assert got == [("fw-spring-boot", "pom.xml")]
    (only,) = findings.profile_findings(none, none, languages, nodes).collect()
    assert only.finding_id == "profile-languages" and only.detail == "java 32"
