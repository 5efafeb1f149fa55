"""Literal rows with known answers."""

import hashlib
import hmac

from pyspark.sql import functions as F

from attestry.functions import detectors, digests, media, passports, profiles, responses, tags, text
from attestry.operators import asset_scores, forensics, metadata_scores, aggregates

FULL = dict(
    file="named_struct('mime_type','image/jpeg','extension','jpg','size',10)",
    container="named_struct('mime_type','image/jpeg','extension','jpg')",
    hashes="named_struct('sha256',repeat('a',64),'md5',repeat('b',32))",
    timestamps="named_struct('created','2024:01:01 08:00:00','modified','2024:06:01 12:00:00')",
    camera="named_struct('make','Canon','model','EOS')",
    gps="named_struct('gps',false,'latitude',cast(null as double),'longitude',cast(null as double))",
    copyright="named_struct('creator','Ann')",
    software="named_struct('editing_software',cast(null as string))",
    exif="map('Make','Canon')",
    raw_tags="map('Image Make','Canon')",
)


def meta(spark, **changed):
    parts = {**FULL, **changed}
    return spark.range(1).selectExpr(*[f"{sql} AS {name}" for name, sql in parts.items()])


def flags(spark, year=2025, **changed):
    row = metadata_scores.metadata_anomaly_rules(meta(spark, **changed), year).first()
    return [f["flag"] for f in row["flags"]], row["anomaly_score"], row["anomaly_summary"]


def test_clean_metadata_has_no_anomaly(spark):
    assert flags(spark) == ([], 0, "none")


def test_reversed_timestamps(spark):
    found, _, _ = flags(spark, timestamps="named_struct('created','2024:06:01 12:00:00','modified','2024:01:01 08:00:00')")
    assert found == ["timestamp_order_reversed"]


def test_future_year_is_a_parameter(spark):
    late = "named_struct('created','2030:01:01 00:00:00','modified','2030:01:01 00:00:01')"
    assert flags(spark, 2025, timestamps=late)[0] == ["timestamp_future"]
    assert flags(spark, 2030, timestamps=late)[0] == []


def test_hash_flags(spark):
    assert flags(spark, hashes="named_struct('sha256',cast(null as string))")[0] == ["hash_missing"]
    assert flags(spark, hashes="named_struct('sha256','abc123')")[0] == ["hash_missing", "hash_malformed"]


def test_gps_removed_and_partial(spark):
    assert flags(spark, raw_tags="map('GPS GPSLatitude','48')")[0] == ["gps_removed"]
    one = "named_struct('latitude',48.0D,'longitude',cast(null as double))"
    assert flags(spark, gps=one)[0] == ["gps_partial"]
    not_a_number = "named_struct('latitude',double('NaN'),'longitude',2.0D)"
    assert "gps_impossible_coordinates" not in flags(spark, gps=not_a_number)[0]
    assert "gps_impossible_coordinates" in flags(spark, gps="named_struct('latitude',95.0D,'longitude',2.0D)")[0]


def test_type_mismatch_scores_at_least_45(spark):
    found, score, _ = flags(spark, container="named_struct('mime_type','image/png','extension','png')")
    assert found == ["mime_mismatch", "extension_mismatch"] and score >= 45


def test_halves_round_to_even(spark):
    # 7 of 14 sections: 12.5 points become 12
    seven = {k: FULL[k] for k in ("file", "container", "hashes", "timestamps", "camera", "gps", "copyright")}
    df = spark.range(1).selectExpr(*[f"{sql} AS {name}" for name, sql in seven.items()])
    row = metadata_scores.metadata_trust_score(df).first()
    assert row["breakdown"]["completeness"] == 12


def test_verdicts(spark):
    base = dict(
        metadata_available=True, metadata_risk="low", credentials_available=True, credentials_risk="low",
        session_available=False, session_risk="neutral", observation_count=0, detector_risk="unknown",
        synthetic_available=False, synthetic_risk="unknown",
    )

    def verdict(**changed):
        return forensics.forensic_verdict(spark.createDataFrame([{**base, **changed}])).first()["verdict"]

    assert verdict(credentials_risk="high") == "high_review_priority"
    assert verdict(credentials_risk="neutral") == "no_major_flags"
    assert verdict(synthetic_available=True, synthetic_risk="high") == "high_review_priority"
    assert verdict(observation_count=2, detector_risk="high") == "high_review_priority"
    assert verdict(session_available=True, session_risk="elevated") == "review_recommended"
    assert verdict(metadata_available=False, metadata_risk="unknown", credentials_available=False) == "insufficient_evidence"


def test_two_detectors_are_not_averaged(spark):
    rows = [("a", 1, "one", "m", "s", "0.21", None, "{}"), ("a", 2, "two", "m", "s", "0.87", None, "{}")]
    df = spark.createDataFrame(
        rows, "asset_id string, observation_id bigint, provider string, model string, signal string, probability string, status string, details string"
    )
    row = aggregates.detector_summary(detectors.normalize_observations(df)).first()
    assert (row["provider_count"], row["highest_risk"], row["consensus_score"]) == (2, "high", None)


def test_risk_band_clamps(spark):
    row = spark.range(1).select(detectors.risk_band(F.lit(0.91)).alias("b"), detectors.risk_band(F.lit(7.0)).alias("c")).first()
    assert (row["b"]["risk"], row["b"]["pct"]) == ("high", 91.0) and row["c"]["probability"] == 1.0


def test_zero_percentage_stays_zero(spark):
    row = spark.range(1).select(
        text.zero_safe_percentage(F.lit(0), F.lit(50)).alias("zero"),
        text.zero_safe_percentage(F.lit(None).cast("double"), F.lit(50)).alias("legacy"),
        text.zero_safe_percentage(F.lit("n/a")).alias("bad"),
        text.zero_safe_percentage(F.lit(" ")).alias("blank"),
    ).first()
    assert tuple(row) == (0.0, 50.0, None, None)


def test_passport_identifiers(spark):
    def gtin(value):
        return spark.range(1).select(passports.gtin14_check(F.lit(value)).alias("c")).first()["c"]

    assert gtin("09506000151519")["valid"]
    assert gtin("09506000151518")["reason"] == "gtin_check_digit"
    assert gtin("9506000151519")["reason"] == "gtin_not_14_digits"
    row = spark.range(1).select(
        passports.serial_check(F.lit("12345678p901"))["valid"],
        passports.resolver_origin_check(F.lit("http://id.example.com"))["url"],
        passports.resolver_origin_check(F.lit("https://id.example.com/"))["url"],
        passports.resolver_origin_check(F.lit("https://id.example.com/x"))["reason"],
        passports.item_uri(F.lit("https://id.gs1.org"), F.lit("09506000151519"), F.lit("a b/~*é")),
    ).first()
    assert row[0] and row[1] is None and row[2] == "https://id.example.com"
    assert "path" in row[3] and row[4] == "https://id.gs1.org/01/09506000151519/21/a%20b%2F~%2A%C3%A9"


def test_mac_equals_hmac(spark):
    for key in (b"short", b"k" * 100):
        expected = hmac.new(key, b"message", hashlib.sha256).hexdigest()
        assert spark.range(1).select(digests.keyed_mac(F.lit("message"), key)).first()[0] == expected


def test_media_types(spark):
    def kind(name, mime=None):
        return spark.range(1).select(media.classify_media(F.lit(name), F.lit(mime)).alias("m")).first()["m"]

    assert kind("Track.FLAC")["family"] == "audio"
    assert kind("noext")["mime_type"] == "application/octet-stream" and not kind("noext")["supported"]
    assert kind("a.png", "image/x")["mime_type"] == "image/x"


def test_profiles_in_catalogue_order(spark):
    def match(name, catalogue):
        return spark.range(1).select(profiles.dictionary_match(F.lit(name), catalogue)).first()[0]

    assert match("Logic Pro X", profiles.APP_PROFILES) == "Logic Pro"
    assert match("Serato DJ Pro", profiles.PROCESS_ONLY) == "Serato DJ Pro"
    assert match("MPC Live II", profiles.HARDWARE_PROFILES) == "Akai MPC Live II"
    assert match("Finder", profiles.APP_PROFILES) is None


def test_tag_lookup_rules(spark):
    df = spark.range(1).selectExpr("map('EXIF:Make','A','make','','IFD0:Make','B','Model','') AS t")
    looked = df.select(tags.tag_lookup(F.col("t")).alias("t"))
    assert looked.select(tags.first_tag("t", ["make"])).first()[0] == "A"
    assert looked.select(tags.first_tag("t", ["model", "make"])).first()[0] == "A"


def test_tag_groups_keep_the_last_value(spark):
    df = spark.range(1).selectExpr("map('EXIF:Make','A','IFD0:Make','B','XMP-x:Tag:2','C','Plain','D') AS t")
    row = df.select(tags.tag_group_partition(F.col("t")).alias("g")).first()["g"]
    assert row["exif"] == {"Make": "B"} and row["xmp"] == {"Tag:2": "C"} and row["iptc"] == {}


def test_attribution_first_wins_ties(spark):
    body = '{"status":[{"response":{"output":[{"classes":[{"class":"udio","score":0.4},{"class":"suno","score":"0.4"},{"class":"cat","score":1}]}]}}]}'
    row = responses.top_attribution(spark.createDataFrame([(body,)], "response string")).first()
    assert row["attribution"]["class"] == "udio"


def test_status_lists_of_nested_results(spark):
    store = (
        '{"active_manifest":"m","validation_results":{"activeManifest":{"success":["a"],"failure":[{"code":"b","success":false}],'
        '"informational":[{"code":"c","success":true}]}},"manifests":{"m":{"validation_results":{"active_manifest":["a","d"]}}}}'
    )
    row = responses.manifest_summary(spark.createDataFrame([("x", store)], "asset_id string, store string")).first()
    assert [s["code"] for s in row["validation_status"]] == ["a", "b", "c", "d"]
    assert row["validation_state"] == "invalid" and row["validation_error_count"] == 1


def test_missing_store_is_not_present(spark):
    df = spark.createDataFrame([("x", "{broken"), ("y", '{"manifests":{}}')], "asset_id string, store string")
    assert {r["validation_state"] for r in responses.manifest_summary(df).collect()} == {"not_present"}


def test_certificate_of_unknown_creator_and_single_owner(spark):
    # class is live_split only with more than one contributor
    df = spark.createDataFrame(
        [(None, [], False, 1, None) + (None,) * 6],
        "ai_detection_score double, ai_tools array<string>, is_disclosed boolean, human_contributor_count int, "
        "ai_modification_by_human boolean, human_creative_direction boolean, human_editing_present boolean, "
        "human_arrangement_present boolean, human_lyrics_present boolean, human_performance_present boolean, "
        "human_transformation_present boolean",
    )
    assert df.select(asset_scores.certificate_class()).first()[0] == "standard"


def test_responses_are_read_at_any_depth(spark):
    odd = '{"result":{"x":[{"class":" AI_generated","score":0.9}]},"output":[{"a":1},2]}'
    deep = '{"a":' * 7 + '{"output":[[{"class":"udio","score":"0.4"}],{"output":[{}]}],"class":"suno","score":0.4}' + "}" * 7
    rows = [(odd, 0.9, 1, None), (deep, None, 2, "suno"), ("{broken", None, 0, None), (None, None, 0, None), ("[]", None, 0, None)]
    df = spark.createDataFrame([(r[0],) for r in rows], "response string")
    for (_, best, segments, top), row in zip(rows, responses.class_max_score(df, "ai_generated").collect()):
        assert (row["probability"], row["segment_count"]) == (best, segments)
    tops = [r["attribution"] and r["attribution"]["class"] for r in responses.top_attribution(df).collect()]
    assert tops == [r[3] for r in rows]


def test_nested_walks_start_no_job_and_follow_each_document(spark):
    deep = '{"a":' * 39 + '{"class":"udio","score":0.4}' + "}" * 39
    flat = '{"class":"udio","score":0.25,"n":[1,{"b":null}],"e":{}}'
    df = spark.createDataFrame([(1, deep), (2, flat), (3, "7"), (4, None)], "id long, response string")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    parsed, leaves = responses.parse_response(df), tags.flatten_nested(df, "id", "response")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) == before
    alone = tags.flatten_nested(df.where("id = 2"), "id", "response")
    size = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert abs(size(leaves) - size(alone)) <= 1
    assert {r.id: [c["score"] for c in r.classes] for r in parsed.collect()} == {1: [0.4], 2: [0.25], 3: [], 4: []}
    got = {(r.id, r.path, r.value) for r in leaves.collect()}
    way = "a." * 39
    expected = {(1, way + "class", "udio"), (1, way + "score", "0.4")}
    expected |= {(2, "class", "udio"), (2, "score", "0.25"), (2, "n[0]", "1"), (2, "n[1].b", None)}
    assert got == expected


def test_documents_are_measured_once_and_scalars_are_not_opened(spark):
    texts = ["[[],[[]],{}]", '{"a":[{},{},{"b":[]},{}],"c":"[[[{\\"["}', '"[[["', "[]", "7", None]
    df = spark.createDataFrame([(t,) for t in texts], "response string")
    assert [r[0] for r in df.select(tags.nesting(F.col("response"))).collect()] == [3, 4, 0, 1, 0, None]
    assert [r[0] for r in df.select(F.size(tags.levels_of(F.col("response")))).collect()] == [3, 4, 0, 1, 0, 0]
    measured = df.select(tags.levels_of(F.col("response")).alias("levels"))._jdf.queryExecution().optimizedPlan().toString()
    assert measured.count("aggregate(") == 1
    plan = responses.parse_response(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "schema_of_variant" not in plan
