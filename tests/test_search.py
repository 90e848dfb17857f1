import pytest

from logspark.functions.search import _terms, field_match
from logspark.operators import filters as C

ROWS = [
    ("1", 1000, "web", "ERROR", "timeout on db", '{"user":"bob","note":"100%"}'),
    ("1", 2000, "web", "INFO", "started fine", '{"user":"eve"}'),
    ("2", 3000, "db", "ERROR", "disk full", '{"user":"bob"}'),
    (None, 4000, "db", "WARN", "slow query_time", '{}'),
]
SCHEMA = "tenant_id string, ms long, source string, level string, message string, raw_json string"


@pytest.fixture
def logs(frame):
    return frame(ROWS, SCHEMA).selectExpr("*", "timestamp_millis(ms) as timestamp").cache()


def hits(df):
    return sorted(r.ms for r in df.collect())


@pytest.mark.parametrize("query, expected", [
    ("", [1000, 2000, 3000, 4000]), ("level:ERROR", [1000, 3000]), ("level:error", []), ("level:ERROR timeout", [1000]), ("user:bob", [1000, 3000]), ("absent:x", []),
    ("level:WARN OR level:INFO", [2000, 4000]), ("level:WARN OR level:ERROR source:db", [3000, 4000]), ('"disk full"', [3000]), ("level:ERROR AND", [1000, 3000]), ("AND level:ERROR", [1000, 3000]),
    ("OR level:ERROR", [1000, 2000, 3000, 4000]), ("level:ERROR OR AND timeout", [1000]), ("100%", [1000]), ("y_t", [4000]), ("%", [1000]), ("bad-name:x", []), ('source:"web"', [1000, 2000]),
    ("TIMEOUT", [1000]), ("BOB", [1000, 3000]),
])
def test_strict(logs, query, expected):
    assert hits(C.log_search(logs, query)) == expected


@pytest.mark.parametrize("query, expected", [("level:error", [1000, 3000]), ("user:BOB", [1000, 3000]), ("WARN", [4000]), ("source:DB", [3000, 4000])])
def test_loose(logs, query, expected):
    assert hits(C.log_search(logs, query, mode="loose")) == expected


def test_bad_field_name():
    with pytest.raises(ValueError):
        field_match("a'b", "x")


def test_bounds_and_tenants(logs):
    assert hits(C.time_between(logs, 1000, 3000)) == [1000, 2000, 3000]
    assert hits(C.tenant_scope(logs, "1")) == [1000, 2000] and hits(C.tenant_scope(logs, "1", allow_null=True)) == [1000, 2000, 4000]
    top = C.log_query(logs, "", limit=2, fields=("user",)).collect()
    assert [(r.source, r.user) for r in top] == [("db", None), ("db", "bob")]


def test_filters_reach_the_scan(spark, logs, tmp_path):
    from logspark.operators.storage import read_stored, write_logs

    path = str(tmp_path / "stored")
    write_logs(logs.fillna("x", ["tenant_id"]).drop("ms"), path)
    plan = C.log_query(read_stored(spark, path), "source:web level:ERROR", "1", 0, 5000)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "(date#" in plan
    assert "EqualTo(source,web)" in plan and "GreaterThanOrEqual(timestamp" in plan
    assert "TakeOrderedAndProject" in plan


def test_windows():
    now = 1_000_000_000_000
    assert C.resolve_window_ms("15m", now) == now - 900_000 and C.resolve_window_ms("-2w", now) == now - 14 * 86_400_000
    assert C.resolve_window_ms("999999999d", now) == C.resolve_window_ms("9" * 40 + "w", now) == -62_135_596_800_000 and C.resolve_window_ms("soon", now) is None and C.resolve_window_ms(None, now) is None
    assert C.resolve_window_ms("2001-01-01T00:00:00Z", now) == 978_307_200_000


RESOURCES = [(1, "a", "svc.prod", 10.0), (2, "a", "svc", 10.0), (3, "b", "svc", 10.0), (4, "a", "svc", 90.0), (5, None, "svc", 1.0)]


@pytest.mark.parametrize("user, action, expected", [
    ({"role": "ADMIN", "tenant_id": "a"}, "write", [1, 2, 4, 5]),
    ({"role": "ANALYST", "tenant_id": "a", "environment_access": ["dev"]}, "read", [2, 4, 5]),
    ({"role": "VIEWER", "tenant_id": "a", "environment_access": ["*"]}, "read", [1, 2, 5]),
    ({"role": "ANALYST", "tenant_id": "a", "environment_access": ["*"], "department": "Engineering"}, "write", []),
    ({"role": "ANALYST", "tenant_id": "b", "environment_access": ["*"], "department": "Security"}, "delete", [3, 5]),
    ({"role": "ANALYST", "tenant_id": "a"}, "read", []),
])
def test_row_policy(frame, user, action, expected):
    rows = frame(RESOURCES, "id int, tenant_id string, domain string, impact_score double")
    assert sorted(r.id for r in C.abac_visible(rows, user, action, "incident").collect()) == expected
    users = frame([(9, user["tenant_id"], user["role"], user.get("department"), user.get("environment_access"))], "id int, tenant_id string, role string, department string, environment_access array<string>")
    assert sorted(r.id for r in C.abac_filter(rows, users, action, "incident").collect()) == expected


def test_trace_and_incident_search(frame):
    traces = frame([("t1", "Pay", "GET /x", 1), ("t2", "cart", "POST /y", 0)], "trace_id string, root_service string, root_operation string, error_count int")
    ids = lambda q: [r.trace_id for r in C.trace_search(traces, q).collect()]
    assert ids("service:pay") == ["t1"] and ids("status:ok") == ["t2"] and ids("status:error get") == ["t1"] and ids("") == ["t1", "t2"] and ids("service:pay status:ok") == []
    incidents = frame([(7, "Disk", "db", "full", "OPEN"), (8, "Net", None, "slow", "RESOLVED")], "id int, title string, domain string, summary string, status string")
    ids = lambda **k: [r.id for r in C.incident_search(incidents, **k).collect()]
    assert ids(text="inc_7") == [7] and ids(status="RESOLVED") == [8] and ids(domain="db", text="FULL") == [7] and ids() == [7, 8]


def test_terms_of_a_search_string():
    cases = {
        "": [], "  ": [], "a b": ["a", "b"], 'level:ERROR "time out" x': ["level:ERROR", '"time out"', "x"], 'msg:"a b"c': ['msg:"a b"', "c"],
        'a:b"c d"': ["a:b", '"c d"'], '"open end': ['"open', "end"], 'f:"open end': ['f:"open', "end"], 'x-y:z "" k:': ["x-y:z", '""', "k:"],
        'pre"fix in"': ['pre"fix', 'in"'], "a AND\tb\nOR c:d": ["a", "AND", "b", "OR", "c:d"], 'a: "b c"': ["a:", '"b c"'], "t:12:30": ["t:12:30"], ':x': [":x"],
    }
    for query, terms in cases.items():
        assert list(_terms(query)) == terms, query
