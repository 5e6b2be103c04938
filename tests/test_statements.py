"""The composed statement read: one sound request, and each reason by one change to its evidence."""

import datetime as dt

from pitspark.operators import statements

T, D = dt.datetime, dt.date
SCHEMAS = {
    "batches": "batch long, issuer long, mapping int, normalizer string, policy string, state string, input_hash string, output_hash string",
    "inputs": "batch long, role string, capture long",
    "captures": "capture long, source string, object_key string, fetched_at timestamp, completed_at timestamp, body_hash string",
    "filings": "version long, filing long, issuer long, filed date, acceptance_at timestamp, metadata_capture long",
    "coverage": "coverage long, batch long, version long, period int, family string, scope string, currency string, authority string, assurance string, state string, basis string",
    "resolutions": "resolution long, coverage long, concept string, scope string, unit string, instrument string, status string, observation long",
    "observations": "observation long, capture long, value double",
    "events": "event long, issuer long, kind string, announced date, version long",
    "event_scopes": "event long, filing long, period int, concept string",
    "quality": "flag long, issuer long, batch long, period int, security string, resolution long, severity string",
}
REQUEST = "request string, issuer long, security string, mapping int, normalizer string, policy string, period int, family string, scope string, unit string, currency string, instrument string, mode string, history_complete boolean, filed_cutoff date, captured_before timestamp, audited boolean, allow_reviewed boolean, concepts array<string>, batches array<long>, captures array<long>, events array<long>, quality array<long>"
COVER = ("whole", "USD", "periodic_complete", "audited", "covered", "us_gaap")


def base():
    return {
        "batches": [(1, 7, 1, "n", "p", "published", "in", "out"), (2, 7, 1, "n", "p", "published", "in2", "out")],
        "inputs": [(1, "metadata", 10), (1, "facts", 11), (1, "facts", 12), (2, "facts", 13)],
        "captures": [(10, "s", "index", T(2024, 1, 1), T(2024, 1, 1), "a"), (11, "s", "facts", T(2024, 1, 1), T(2024, 1, 1), "b"), (12, "s", "facts", T(2024, 1, 2), T(2024, 1, 2), "c"), (13, "s", "more", T(2024, 1, 1), T(2024, 1, 1), "d")],
        "filings": [(100, 1000, 7, D(2023, 5, 1), T(2023, 5, 1, 9), 10), (101, 1001, 7, D(2023, 8, 1), T(2023, 8, 1, 9), 10)],
        "coverage": [(1, 1, 100, 5, "income", *COVER), (2, 1, 101, 5, "income", *COVER)],
        "resolutions": [(1, 1, "revenue", "whole", "USD", None, "observed", 1), (2, 2, "revenue", "whole", "USD", None, "observed", 2), (3, 2, "net_income", "whole", "USD", None, "observed", 3)],
        "observations": [(1, 12, 5.0), (2, 12, 6.0), (3, 13, 7.0)],
        "events": [(50, 7, "withdrawal", D(2023, 9, 1), 101), (51, 7, "amendment", D(2023, 9, 1), 101)],
        "event_scopes": [(50, 1001, None, None), (51, 1001, None, None)],
        "quality": [(60, 7, 1, 5, None, None, "warning"), (61, 7, 1, None, None, 2, "error"), (62, 7, 1, 9, None, None, "error")],
    }


def asked(**other):
    row = {
        "request": "r", "issuer": 7, "security": None, "mapping": 1, "normalizer": "n", "policy": "p", "period": 5, "family": "income", "scope": "whole", "unit": "USD", "currency": "USD", "instrument": None, "mode": "original_as_filed", "history_complete": True, "filed_cutoff": None,
        "captured_before": T(2024, 2, 1), "audited": False, "allow_reviewed": False, "concepts": ["revenue"], "batches": [1, 2], "captures": [10, 11, 12, 13], "events": [], "quality": [],
    } | other
    return tuple(row.values())


def read(spark, requests, **changed):
    tables = {name: spark.createDataFrame([tuple(r) for r in rows], SCHEMAS[name]) for name, rows in (base() | changed).items()}
    found = statements.read(spark.createDataFrame(requests, REQUEST), statements.Evidence(**tables)).collect()
    return {r.request: r for r in found}


def told(row):
    return list(row.flags), {f.concept: (f.status, f.value) for f in row.facts}, row.usable


def test_many_requests_at_once(spark):
    more = {"mode": "latest_reported", "concepts": ["revenue", "net_income"]}
    got = read(
        spark,
        [
            asked(), asked(request="late", mode="original_as_filed", history_complete=False), asked(request="dated", mode="as_filed_by_date", filed_cutoff=D(2023, 6, 1)), asked(request="latest", **more), asked(request="gone", mode="latest_reported", events=[50]), asked(request="later", **more, filed_cutoff=D(2023, 8, 15), events=[50, 51]),
            asked(request="odd", quality=[60]), asked(request="elsewhere", quality=[62]), asked(request="none", period=6), asked(request="lost", batches=[1, 9]), asked(request="few", captures=[10, 11, 12]), asked(request="early", captured_before=T(2024, 1, 1, 12)), asked(request="missing", concepts=["assets", "revenue"]),
            asked(request="audited", audited=True), asked(request="other", currency="EUR"), asked(request="unit", unit="shares"), asked(request="event", events=[99]),
        ],
    )
    assert told(got["r"]) == ([], {"revenue": ("observed", 5.0)}, True) and got["r"].versions == [100] and got["r"].basis == "us_gaap"
    assert told(got["late"]) == (["earliest_available"], {"revenue": ("observed", 5.0)}, True)
    assert told(got["dated"]) == ([], {"revenue": ("observed", 5.0)}, True)
    assert told(got["latest"]) == (["blocking_quality_flag", "revised_view"], {"revenue": ("observed", 6.0), "net_income": ("observed", 7.0)}, False)  # an error on the resolution that was read
    assert told(got["gone"])[0] == ["blocking_quality_flag", "revised_view", "withdrawal"]
    assert told(got["later"])[0] == ["blocking_quality_flag", "revised_view"]  # announced after the cutoff; an amendment takes nothing back
    assert told(got["odd"])[2] and told(got["elsewhere"]) == (["incompatible_quality_manifest"], {"revenue": ("unavailable", None)}, False)
    reasons = {"none": "coverage_unavailable", "lost": "unpublished_or_missing_batch", "few": "incompatible_capture_manifest", "early": "capture_unavailable", "other": "coverage_unavailable", "event": "incompatible_event_manifest"}
    assert {k: told(got[k]) for k in reasons} == {k: ([v], {"revenue": ("unavailable", None)}, False) for k, v in reasons.items()}
    assert told(got["missing"]) == (["unresolved_concept"], {"assets": ("missing", None), "revenue": ("observed", 5.0)}, False)
    assert told(got["audited"])[2] and told(got["unit"])[1] == {"revenue": ("missing", None)}


def changed(table, at, **columns):
    rows, names = [list(r) for r in base()[table]], [c.split()[0] for c in SCHEMAS[table].split(", ")]
    for name, value in columns.items():
        rows[at][names.index(name)] = value
    return {table: rows}


def more(table, row):
    return {table: [*base()[table], row]}


CASES = [
    (changed("batches", 1, state="staged"), "unpublished_or_missing_batch"),
    (changed("batches", 1, mapping=2), "incompatible_batch_revision"),
    (changed("batches", 1, input_hash="in", output_hash="else"), "nondeterministic_normalization"),
    (changed("captures", 3, completed_at=None), "capture_unavailable"),
    (changed("captures", 1, fetched_at=T(2024, 1, 2)), "ambiguous_capture_vintage"),
    (more("inputs", (2, "index", 11)), "incompatible_source_roles"),
    (more("coverage", (3, 2, 102, 5, "income", *COVER)) | more("filings", (102, 1002, 7, D(2023, 5, 1), None, 10)), "ambiguous_filing_order"),
    (more("coverage", (3, 2, 102, 5, "income", *COVER)) | more("filings", (102, 1002, 7, D(2023, 5, 1), T(2023, 5, 1, 9), 10)), "ambiguous_filing_order"),
    (more("coverage", (3, 2, 100, 5, "income", *COVER[:-1], None)), "incompatible_reporting_basis"),
    (changed("coverage", 0, currency=None), "unresolved_coverage"),
    (changed("coverage", 0, state="partial"), "unresolved_coverage"),
    (changed("coverage", 0, authority="reviewed_equivalent") | changed("filings", 1, metadata_capture=11), "coverage_unavailable"),
]
OWN = {"batch", "issuer", "capture", "version", "filing", "metadata_capture", "coverage", "resolution", "observation", "event", "flag"}


def test_each_reason_ends_a_request(spark):
    tables, requests = {name: [] for name in SCHEMAS}, []
    for k, (change, _) in enumerate(CASES):  # each case has evidence of its own, in one job
        shift = lambda v: None if v is None else v + 1000 * 1000 * k  # noqa: B023, E731
        for name, rows in (base() | change).items():
            own = [c.split()[0] in OWN for c in SCHEMAS[name].split(", ")]
            tables[name] += [tuple(shift(v) if o else v for v, o in zip(r, own)) for r in rows]
        requests.append(asked(request=str(k), issuer=shift(7), batches=[shift(v) for v in (1, 2)], captures=[shift(v) for v in (10, 11, 12, 13)]))
    got = read(spark, requests, **tables)
    want = {str(k): ([reason], {"revenue": ("unavailable", None)}, False) for k, (_, reason) in enumerate(CASES)}
    assert {k: told(r) for k, r in got.items()} == want


def test_one_day_by_verified_times(spark):
    change = more("coverage", (3, 2, 102, 5, "income", *COVER)) | more("filings", (102, 1002, 7, D(2023, 5, 1), T(2023, 5, 1, 8), 10)) | more("resolutions", (9, 3, "revenue", "whole", "USD", None, "observed", 2))
    assert told(read(spark, [asked()], **change)["r"]) == ([], {"revenue": ("observed", 6.0)}, True)


def test_states_of_a_fact(spark):
    stale = read(spark, [asked()], **changed("observations", 0, capture=11))["r"]
    assert told(stale) == (["unresolved_concept"], {"revenue": ("stale_source", None)}, False)
    twice = read(spark, [asked()], **more("resolutions", (9, 1, "revenue", "whole", "USD", None, "missing", None)))["r"]
    assert told(twice) == (["ambiguous_resolution"], {"revenue": ("ambiguous", None)}, False)
    same = read(spark, [asked()], **more("resolutions", (9, 1, "revenue", "whole", "USD", None, "observed", 1)))["r"]
    assert told(same) == ([], {"revenue": ("observed", 5.0)}, True) and same.facts[0].resolutions == [1, 9]
    other = read(spark, [asked()], **changed("resolutions", 0, instrument="common"))["r"]
    assert told(other)[1] == {"revenue": ("missing", None)}


def test_no_requests(spark):
    assert read(spark, []) == {}


def test_evidence_meets_each_pin_once(spark, monkeypatch):
    """Requests that pin the same do not multiply what is joined with it."""
    tables = statements.Evidence(**{name: spark.createDataFrame([tuple(r) for r in rows], SCHEMAS[name]) for name, rows in base().items()})
    seen, stored = {}, statements.stored
    monkeypatch.setattr(statements, "stored", lambda df, name: seen.setdefault(name, stored(df, name)))
    requests = spark.createDataFrame([asked(request=f"{n}-{mode}", period=n) for n in range(20) for mode in ("original_as_filed", "latest_reported")] + [asked(request="few", captures=[10])], REQUEST)
    found = {r.request: (r.reason, sorted(r.chosen)) for r in statements.bundles(requests, tables).collect()}
    assert len(found) == 41 and found["few"][0] == "incompatible_capture_manifest" and found["3-latest_reported"] == (None, [10, 12, 13])
    assert seen["vintages"].count() == 8  # two pins of four captures
