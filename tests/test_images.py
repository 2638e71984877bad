from wareloom.plans import registry

QUERIES = ["photo_best_copy", "image_rank", "image_first_pass", "best_low_res", "gate_violations"]


def brute(parts):
    """What each of the image queries gives, part by part."""
    out = {name: set() for name in QUERIES}
    uploads = 0
    for key, size in parts:
        shots = []
        for n in range(6):
            width, height = size * (n + 3) * 17 % 1600, size * (n + 1) * 23 % 1600
            shots.append((n, width, height, ["structured", "og", "src"][n % 3], f"p{key}-{n // 2}.jpg"))
        best, order, passed, low = {}, [], 0, []
        for n, w, h, source, photo in shots:
            if photo not in best or w * h > best[photo][1]:
                best[photo] = (n, w * h)
            tier = 0 if min(w, h) >= 800 else 1 if max(w, h) >= 800 else 2
            order.append((tier, -max(w, h), ["structured", "og", "src"].index(source), n))
            verdict = "not_decodable" if not w * h else "below_hard_minimum" if min(w, h) < 400 else "below_min_dimensions" if min(w, h) < 800 else "ok"
            if passed < 2:
                out["image_first_pass"].add((key, n, verdict))
            passed += verdict == "ok"
            low += [(w * h, -n)] if verdict == "below_min_dimensions" else []
        out["photo_best_copy"] |= {(key, photo, n, area) for photo, (n, area) in best.items()}
        out["image_rank"] |= {(key, n, k) for k, (*_, n) in enumerate(sorted(order), 1)}
        if low:
            out["best_low_res"].add((key, -max(low)[1], max(low)[0]))
        uploads += not passed and not low
    out["gate_violations"] = {(len(parts), uploads, 0)}
    return out


def test_all_parts_give_candidates(spark, tmp_path):
    parts = [(k, k % 50 + 1) for k in [*range(1990, 2060), 5_000_000_000]]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want = brute(parts)
    for name in QUERIES:
        got = [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()]
        assert len(got) == len(set(got)) and set(got) == want[name], name
