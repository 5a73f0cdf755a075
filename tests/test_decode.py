"""The four decoders on lines of every shape they tell apart."""

from __future__ import annotations

from tests.helpers import lines_of, rows_of

from tallylog.model import BAD_CSV, BAD_JSON, BAD_SYSLOG
from tallylog.sources import decode_csv, decode_json, decode_syslog, decode_text


def test_json_objects(spark):
    rows = rows_of(
        decode_json(
            lines_of(
                spark,
                '{"t":"2031-03-04T05:06:07+02:00","lvl":"dbg","text":"valve opened","app":"plant-7","bar":2.5}',
                '{"severity":"wrn","message":"","hostname":"crane-4","load":[1,{"kg":90}],"ok":true}',
            )
        )
    )
    assert [(r.level, r.message, r.source, r.time, r.line) for r in rows] == [
        ("DEBUG", "valve opened", "plant-7", "2031-03-04T03:06:07Z", 1),
        ("WARN", None, "crane-4", None, 2),
    ]
    assert rows[0].fields == {"bar": "2.5"}
    assert rows[1].fields == {"load": '[1,{"kg":90}]', "ok": "true"}


def test_json_rejects(spark):
    bad = ["pressure falling", "null", "[1]", "{'a':1}", '{"a":1} x', '{"a":NaN}', '"text"', "{"]
    rows = rows_of(decode_json(lines_of(spark, *bad, '\t{"text":"fine"}  ')))
    assert [r.parse_error for r in rows] == [BAD_JSON] * len(bad) + [None]
    assert [r.message for r in rows] == [*bad, "fine"]
    assert rows[0].raw == bad[0] and rows[0].fields == {} and rows[0].level is None


def test_json_aliases(spark):
    rows = rows_of(
        decode_json(
            lines_of(
                spark,
                '{"LogLevel":"ftl","MSG":"upper","@Timestamp":"04/Mar/2031:05:06:07 -0100","Left":"x"}',
                '{"time":"soon","ts":"2031/03/04 05:06:07","text":"second","msg":"first","host":"h","service":"s"}',
                '{"LVL":"trc","lvl":"err","severity":"inf","a":1,"a":2,"n":null,"o":{"k":[1,"x"]}}',
                '{"level":"","msg":null,"text":"kept"}',
            )
        )
    )
    assert (rows[0].level, rows[0].message, rows[0].time) == ("FATAL", "upper", "2031-03-04T06:06:07Z")
    assert rows[0].fields == {"Left": "x"}
    assert (rows[1].time, rows[1].message, rows[1].source, rows[1].fields) == ("2031-03-04T05:06:07Z", "first", "s", {})
    assert (rows[2].level, rows[2].fields) == ("INFO", {"a": "2", "o": '{"k":[1,"x"]}'})
    assert (rows[3].level, rows[3].message) == (None, "kept")


def test_json_epochs(spark):
    """A bare number is epoch seconds; the same digits in quotes are no time."""
    rows = rows_of(
        decode_json(
            lines_of(
                spark,
                '{"ts":86400}',
                '{"Time": 86400.75}',
                '{"ts":"86400"}',
                '{"t":"20310304"}',
                '{"ts":"never","t":-1}',
            )
        )
    )
    assert [r.time for r in rows] == ["1970-01-02T00:00:00Z", "1970-01-02T00:00:00Z", None, None, "1969-12-31T23:59:59Z"]


def test_text_shapes(spark):
    rows = rows_of(
        decode_text(
            lines_of(
                spark,
                "2031-03-04 05:06:07 TRACE pump primed at 3 bar",
                "[2031-03-04T05:06:08] [NOTE] belt [2] slipping",
                "2031/03/04 05:06:09,25 - oops - lamp out",
                "PANIC 2031-03-04 05:06:10 core hot",
                "2031-03-04 05:06:11 lid shut",
                "wind from the north",
                "2031-03-04 05:06:12 DEBUG [belt-2] a ] b",
                "2031-03-04T05:06:07Z DEBUG zone letter",
                "2031/03/04T05:06:07 DEBUG slashes and a T",
                "2031-03-04 05:06:07 debug lower case",
                "[2031-03-04 05:06:07 x\x01y] [crit] a]b]c",
                "\x01 control first",
                "FATAL 2031-03-04 05:06:07.5 ",
            )
        )
    )
    got = [(r.time, r.level, r.source, r.message) for r in rows]
    day = "2031-03-04T05:06:"
    assert got == [
        (day + "07Z", "TRACE", None, "pump primed at 3 bar"),
        (day + "08Z", "NOTE", None, "belt [2] slipping"),
        (day + "09Z", "OOPS", None, "lamp out"),
        (day + "10Z", "PANIC", None, "core hot"),
        (day + "11Z", None, None, "lid shut"),
        (None, None, None, "wind from the north"),
        (day + "12Z", "DEBUG", "belt-2", "a ] b"),
        (None, None, None, "2031-03-04T05:06:07Z DEBUG zone letter"),
        (None, "DEBUG", None, "slashes and a T"),
        (day + "07Z", None, None, "debug lower case"),
        (None, "FATAL", None, "a]b]c"),
        (None, None, None, "\x01 control first"),
        (day + "07Z", "FATAL", None, None),
    ]
    assert all(r.parse_error is None for r in rows)


def test_csv(spark):
    header = ["date", "loglevel", "description", "app", "Bay"]
    lines = lines_of(
        spark,
        "2031-03-04T05:06:07Z,inf,crate in,dock,",
        '2031-03-04 05:06:07,panic,"say ""no"", twice", padded,"x "y" z"',
        "only,three,cells",
        "a,b,c,d,e,f",
    )
    rows = rows_of(decode_csv(lines, header))
    assert [(r.time, r.level, r.message, r.source, r.fields["Bay"]) for r in rows] == [
        ("2031-03-04T05:06:07Z", "INFO", "crate in", "dock", ""),
        ("2031-03-04T05:06:07Z", "PANIC", 'say "no", twice', "padded", 'x "y" z'),
    ]
    assert rows[0].fields["loglevel"] == "inf" and len(rows[0].fields) == 5
    assert rows[0].raw == "2031-03-04T05:06:07Z,inf,crate in,dock,"
    kept = rows_of(decode_csv(lines, header, keep_rejected=True))
    assert [r.parse_error for r in kept] == [None, None, BAD_CSV, BAD_CSV]
    assert kept[2].raw == "only,three,cells"


def test_csv_leftmost_header_wins(spark):
    rows = rows_of(decode_csv(lines_of(spark, "d,t,a,m"), ["description", "text", "App", " Message "]))
    assert (rows[0].message, rows[0].source) == ("d", "a")


def test_syslog(spark):
    rows = rows_of(
        decode_syslog(
            lines_of(
                spark,
                "<165>Oct 31 23:59:59 crane-4 lift[77]: chain at 40 %",
                "Nov  1 00:00:00 crane-4 brake: set",
                "<0>Feb 29 12:00:00 well pump[3]:",
                "tide coming in",
                "<999>Oct 31 23:59:59 h[1] my app : [a] b: c",
                "<12>Feb 30 08:00:00 h p:",
            ),
            2028,
        )
    )
    first = rows[0]
    assert (first.source, first.message, first.level) == ("crane-4", "chain at 40 %", "NOTICE")
    assert first.fields == {
        "priority": "165", "facility": "20", "severity": "5", "hostname": "crane-4", "process": "lift", "pid": "77",
    }
    assert (rows[1].level, rows[1].time, rows[1].fields) == (None, "2028-11-01T00:00:00Z", {"hostname": "crane-4", "process": "brake"})
    assert (rows[2].level, rows[2].time, rows[2].message) == ("EMERGENCY", "2028-02-29T12:00:00Z", None)
    assert (rows[3].message, rows[3].parse_error) == (rows[3].raw, BAD_SYSLOG)
    assert (rows[4].source, rows[4].message, rows[4].fields["process"]) == ("h[1]", "[a] b: c", "my app")
    assert rows[4].fields["facility"] == "124" and "pid" not in rows[4].fields
    assert (rows[5].time, rows[5].level, rows[5].message) == (None, "WARN", None)
