"""Known values of the scalar functions, the analyzers and the schema rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veinstone.functions import analyzers as A, text as S, times as T
from veinstone.operators import export as E, harvest as H, relational as R, schema
from veinstone.sources.config import Cached, parse_yaml, repositories


def value(spark, column, **row):
    df = spark.range(1).select(*[(F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v))).alias(k) for k, v in row.items()])
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "values, name",
    [
        (["Université de Toulouse"], "universite-de-toulouse"),
        (["Lopez v. Monterey County : photocopies of the case"], "lopez-v-monterey-county-photocopies"),
        (["Универзитет во Скопје/Ss. Cyril and Methodius University of Skopje"], "ss-cyril-and-methodius-university"),
        (["scm.123/ more stuff.xml"], "scm-123-more-stuff"),
        ([None, "", "Скопје", "ABC.XML"], "abc"),
        (["Скопје"], None),
        ([], None),
    ],
)
def test_identifiers(values, name):
    assert S.identifier_text(values) == name


def test_identifier_columns(spark):
    assert value(spark, S.identifier(F.col("a"), F.col("b")), a="  ", b="Ünder Score_1.xml") == "under-score_1"
    assert value(spark, S.parameterize(F.col("a")), a="Á b") == "a-b"
    with pytest.raises(Exception, match="no identifier"):
        value(spark, S.require_identifier(F.lit(None).cast("string")), a=1)


@pytest.mark.parametrize("a, b, out", [("T,", "1963", "T, 1963"), (" T , ", "", "T"), ("", "1963", "1963"), (None, None, S.NO_TITLE), (",", None, S.NO_TITLE)])
def test_titles(spark, a, b, out):
    assert value(spark, S.title(F.col("a").cast("string"), F.col("b").cast("string")), a=a, b=b) == out


def test_links_and_objects(spark):
    base = "https://objects.example.org/"
    for href, out in (("http://objects.example.org/ab123cd4567", "https://objects.example.org/ab123cd4567"), (" ab123cd4567 ", "https://objects.example.org/ab123cd4567"), ("http://other.org", "http://other.org")):
        assert value(spark, S.link(F.col("a"), base), a=href) == out
    got = value(spark, S.digital_objects(F.col("a"), base), a=['{"label": "", "href": "ab123cd4567"}', " ", '{"label": "x", "href": "y"}'])
    assert [tuple(o) for o in got] == [(base + "ab123cd4567", base + "ab123cd4567"), ("x", "y")]


def test_texts(spark):
    assert value(spark, S.extent(F.col("a")), a=["1 Box", "This is an extensive extent so we should truncate it"]) == "1 Box; This is an extensive..."
    assert value(spark, S.language(F.col("a")), a="English .") == "English."
    assert value(spark, S.hyphenate_ark(F.col("a")), a="ark:/12345/c8" + "a" * 32) == "ark:/12345/c8aaaaaaaa-aaaa-aaaa-aaaa-aaaaaaaaaaaa"
    assert value(spark, S.hyphenate_ark(F.col("a")), a="other") == "other"
    assert value(spark, S.file_path(F.lit("/d"), F.col("a"), "pdf"), a="x.xml") == "/d/x.pdf"
    assert value(spark, S.truncate(F.col("a"), 10), a="one two three") == "one two..."
    assert value(spark, S.restrictions(F.col("a"), 8), a=["one two", "three"]) == "one two"
    assert value(spark, S.capitalised(F.col("a")), a="box") == "Box"
    assert value(spark, S.csv_name("bookmarks", F.lit(dt.date(2024, 5, 6))), a=1) == "bookmarks-20240506.csv"
    assert value(spark, S.sort_text(F.col("a")), a=" 1963-1972 É") == "19631972"


@pytest.mark.parametrize("t, out, wait", [("10:00:00", "10:30:00", 1800), ("10:30:00", "11:00:00", 1800), ("10:29:59", "10:30:00", 5), ("10:45:00", "11:00:00", 900), ("23:31:00", "00:00:00", 1740)])
def test_half_hours(spark, t, out, wait):
    now = dt.datetime.fromisoformat(f"2024-01-01T{t}")
    assert value(spark, T.next_half_hour(F.col("a")), a=now).strftime("%H:%M:%S") == out
    assert value(spark, T.seconds_until_next_half_hour(F.col("a")), a=now) == wait


def test_hours(spark):
    body = '{"data": {"attributes": {"hours": [{"open": true, "opens_at": "2024-01-01T09:00:00Z", "closes_at": "2024-01-01T17:00:00Z"}, {"open": true, "opens_at": "2024-01-02T09:30:00Z", "closes_at": "2024-01-02T17:00:00Z"}]}}}'
    h, now = T.parse_hours(F.col("a")), F.to_timestamp(F.lit("2024-01-01 17:00:00"))
    none = F.lit(None).cast("string")
    assert value(spark, T.open_now(h, now, none), a=body) is True and value(spark, T.open_now(h, now, F.lit("closed")), a=body) is False
    assert value(spark, T.clock(T.next_open(h, now, none)["opens_at"], F.lit(dt.date(2024, 1, 1))), a=body) == "9:30am"
    assert value(spark, T.clock(T.next_open(h, now, none)["opens_at"], F.lit(dt.date(2023, 1, 1))), a=body) == "9:30am Tuesday"
    assert value(spark, T.parse_hours(F.col("a")), a="broken") == [] and value(spark, T.hours_today(h, none)["open"], a=body) is True
    assert value(spark, T.years_of(F.col("a")), a="1963/1965") == [1963, 1964, 1965]


def test_analyzers(spark):
    assert [A.stem(w) for w in ("boxes", "stories", "glass", "bus", "letters", "zwhacky", "is")] == ["boxe", "story", "glass", "bus", "letter", "zwhacky", "is"]
    assert A.text_tokens("Études' Box-files") == [(0, "etudes"), (0, "etude"), (1, "box"), (2, "files"), (2, "file")]
    assert {t for _, t in A.english_tokens("WiFi TV's 4K")} >= {"wi", "fi", "tv", "television", "4", "k"}
    assert A.identifier_tokens("SC0097.xml") == ["sc", "0097", "sc0097"]
    assert A.word_parts("PowerShot-TVs_Café12 XMLFile") == ["Power", "Shot", "TVs", "Café", "12", "XMLFile"]
    assert [t for _, t in A.english_tokens("Café Éclair")] == ["cafe", "eclair"]
    assert A.query_terms("letters - 1900 .") == ["letters", "1900"]
    got = value(spark, A.analyze_values(F.col("a")), a=["one two", "three"])
    assert [(r.pos, r.token) for r in got] == [(0, "one"), (1, "two"), (100, "three")]
    assert value(spark, A.spell_tokens(F.col("a")), a="The box and THE lid") == ["box", "lid"]


def test_schema_rules(spark):
    assert schema.kind_of("x_ssim").many and not schema.kind_of("x_tesm").indexed and not schema.kind_of("title_sort").stored
    with pytest.raises(ValueError):
        schema.kind_of("x_unknown")
    docs = spark.createDataFrame([("a", "a.xml", ["SC 1"], ["T, 1900"], ["The History"])], "id string, ead_ssi string, unitid_ssm array<string>, normalized_title_ssm array<string>, abstract_tesim array<string>")
    got = schema.derive(docs).first()
    assert got.identifier_search == ["a", "a.xml", "SC 1"] and got.text == ["T, 1900", "The History", "SC 1"] and got.title_sort == "t1900" and got.unitid_identifier_match == ["sc", "1", "sc1"][:2]
    assert "title_sort" not in schema.stored(schema.derive(docs)).columns


def test_safeguards():
    for deletes, indexed, bad in ((101, 200, True), (50, 200, False), (50, 50, True)):
        if bad:
            with pytest.raises(ValueError):
                H.check_deletes(deletes, indexed)
        else:
            H.check_deletes(deletes, indexed)
    with pytest.raises(H.TooManyUris):
        H.check_uris(900)
    H.check_uris(899)
    assert H.source_plan(exclude={"uri": ["a"]}).count("negated") == 1 and "suppressed" not in H.source_plan()


def test_changes_or_all(spark):
    own, some, every = (spark.createDataFrame([(u,) for u in us], "uri string") for us in ("ab", "bcc", "abcd"))
    assert sorted(r.uri for r in H.changes_or_all(own, some, some, every)[0].collect()) == ["a", "b", "c"]
    rows, fell_back = H.changes_or_all(own, some, some, every, most=2)
    assert fell_back and sorted(r.uri for r in rows.collect()) == ["a", "b", "c", "d"]
    assert H.changes(own, some, some, dedupe=False).count() == 6


def test_lists(spark):
    assert [value(spark, E.list_number(F.lit(n), F.lit(s)), a=1) for n, s in ((4, "lowerroman"), (19, "upperroman"), (3, "upperalpha"), (2, "arabic"), (1, "x"))] == ["iv", "XIX", "C", "2", "•"]
    assert value(spark, E.section_order(F.col("a")), a="bioghist") == 2 and value(spark, E.section_order(F.col("a")), a="zzz") is None
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert R.pick_one(ids, 3).collect() == R.pick_one(ids, 3).collect()


def test_settings(spark):
    text = "# names\nars:\n  name: Archive\n  request_types:\n    web:\n      url: https://x.org/a\nuarc:\n  name: 'University'\n"
    assert parse_yaml(text)["ars"]["request_types"]["web"]["url"] == "https://x.org/a"
    assert sorted(r.slug for r in repositories(spark, text).collect()) == ["ars", "uarc"]
    now, made = [0.0], []
    cached = Cached(lambda: made.append(1) or len(made), 10, lambda: now[0])
    assert (cached.get(), cached.get()) == (1, 1)
    now[0] = 10
    assert cached.get() == 2
