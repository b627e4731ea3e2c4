"""Reports: sections, defaults and merges, numbers that JSON can't hold, custody and the legal form."""

import json

from evidentia.operators import reports


def made(spark):
    inf, nan = float("inf"), float("nan")
    runs = [
        ("r1", "a.png", "completed", "2024-05-01T10:00:00", ("bar", {"width": "3"}, "c.png", "m.png", None, True), (20.0, 0.5), (inf, 0.9), (4.25, 0.4, 7.0), True, (0.7, 0.8, nan), "inpainting", {"seed": "42", "retry_count": "2"}),
        ("r2", None, None, None, None, None, None, (None, None, -3.0), None, None, None, None),
        ("r3", "b.png", "failed", "t", ("noise", None, None, None, True, None), (1.0, 0.1), (1.0, 0.1), (0.0, 0.0, 0.1), False, (0.3, 0.1, 0.2), "denoise", {"execution_mode": "blind"}),
    ]
    cands = [("r1", 1, "lama_big", "x", 90.5, 30.0, 0.9, 10.0, 0.4, "supervised"), ("r1", 0, "patchmatch_p7", "y", 90.5, inf, 0.8, 1.0, 0.1, None), ("r1", 2, "broken", None, None, None, None, None, None, None), ("r3", 0, None, "z", 41.0, 1.0, 0.1, 0.0, 0.0, "blind"), (None, 0, "lost", None, 1.0, None, None, None, None, None)]
    return spark.createDataFrame(runs, reports.RUN), spark.createDataFrame(cands, reports.CANDIDATE)


def test_reports(spark):
    runs, cands = made(spark)
    df = reports.reports(runs, cands, {"execution_mode": "assisted", "seed": "7"})
    got = {r["run_key"]: json.loads(r["j"]) for r in df.select("run_key", reports.text("report").alias("j")).collect()}
    a, b, c = got["r1"], got["r2"], got["r3"]
    assert a["input"] == {"source_image": "a.png", "corruption_type": "bar", "execution_mode": "assisted", "detection_mode": None, "seed": "42"}
    assert [x["strategy"] for x in a["reconstruction"]["all_candidates"]] == ["patchmatch_p7", "lama_big", "broken"]
    assert a["reconstruction"]["best_candidate"]["psnr"] == "inf" and a["reconstruction"]["retry_count"] == 2 and set(a["reconstruction"]["best_candidate"]) == set(reports.SLIM)
    assert a["metrics"]["original_vs_reconstructed"] == {"psnr": "inf", "ssim": 0.9} and a["metrics"]["detection_metrics"]["recall"] == "nan"
    assert a["analysis"]["notes"] == ["located and improved", "PSNR gain +4.3 dB", "SSIM gain +0.400", "excellent score"]
    assert a["corruption"] == {"type": "bar", "parameters": {"width": "3"}, "image_path": "c.png", "mask_path": "m.png", "detected_mask": None, "randomize": False, "imperfect_mask": True}
    assert b["reconstruction"]["all_candidates"] == [] and b["reconstruction"]["best_candidate"]["strategy"] is None and b["status"] == "completed"
    assert b["analysis"] == {"detection_quality": "poor", "repair_effectiveness": "degraded", "score_level": "poor", "score": 0.0, "iou": 0.0, "psnr_gain": 0.0, "ssim_gain": 0.0, "notes": ["imprecise detection", "no measurable gain"]}
    assert c["analysis"]["notes"] == ["nothing unusual"] and c["analysis"]["repair_effectiveness"] == "neutral" and c["input"]["execution_mode"] == "blind" and c["analysis"]["score_level"] == "medium"
    assert len({x["run_id"] for x in got.values()}) == 3 and all(len(x["run_id"]) == 12 for x in got.values())
    assert reports.reports(runs.where("false"), cands).count() == 0


def test_legal_reports(spark):
    runs, cands = made(spark)
    digests = spark.createDataFrame([("r1", "o", "c", "n"), ("r3", None, "c3", "n3")], "run_key string, original string, corrupted string, reconstructed string")
    base = reports.reports(runs, cands.where("seq > 0 or run_key = 'r3'"))
    got = {r["run_key"]: json.loads(r["j"]) for r in reports.legal(base, digests, reports.F.lit("now")).select("run_key", reports.text("legal").alias("j")).collect()}
    a, b, c = got["r1"], got["r2"], got["r3"]
    assert [(s["step"], s["path"], s["sha256"]) for s in a["chain_of_custody"]] == [("1_original", "a.png", "o"), ("2_corrupted", "c.png", "c"), ("3_reconstructed", "x", "n")]
    assert a["chain_of_custody"][2]["note"] and a["chain_of_custody"][0]["note"] is None and {s["timestamp"] for s in a["chain_of_custody"]} == {"now"}
    assert a["forensic_mode"] == "generative" and "generative" in a["warning"] and a["sha256_reconstructed"] == "n" and a["legal_report"] is True and a["analysis_id"] == a["run_id"]
    assert [(m["strategy"], m["forensic_safe"], m["mode"]) for m in a["table_of_methods"]] == [("lama_big", False, "supervised"), ("broken", True, "blind")]
    assert b["chain_of_custody"] == [] and b["forensic_mode"] == "forensic_safe" and b["sha256_original"] == ""
    assert [(s["step"], s["sha256"]) for s in c["chain_of_custody"]] == [("1_original", ""), ("3_reconstructed", "n3")] and c["table_of_methods"][0]["strategy"] == "—"
    assert set(a) > {"reconstruction", "metrics", "analysis", "certifications", "disclaimer", "legal_note", "report_version"}
