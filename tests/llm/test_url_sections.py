from trajspark.llm import urls


def test_sections_of_small_share_are_judged_by_their_own_labels(spark):
    rules = [urls.Rule("x.net", "/es/", urls.BLOCK), urls.Rule("x.net", "/fr/", urls.BLOCK)]
    sections = ["es", "fr"] + [f"s{chr(97 + k // 10)}{chr(97 + k % 10)}" for k in range(98)]
    pages = [(100 * k + i, f"http://x.net/{name}/{i}") for k, name in enumerate(sections) for i in range(20)]
    found = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()
    for r in found:
        listed = r.path.startswith(("/es/", "/fr/"))
        assert r.verdict == (urls.BLOCK if listed else urls.ALLOW), r
    assert len({r.template for r in found}) == 2


def test_small_bad_section_is_told_from_clean_ones(spark):
    rows = [("h", f"/c{chr(97 + k // 10)}{chr(97 + k % 10)}/{i}", 0) for k in range(99) for i in range(30)]
    rows += [("h", f"/bad/{i}", 1) for i in range(30)]
    found = {r["shape"]: r for r in urls.path_templates(spark.createDataFrame(rows, "host string, path string, bad int")).collect()}
    assert found["bad/{n}"].bad == found["bad/{n}"].labelled == 30
    assert found["caa/{n}"].bad == 0 and found["caa/{n}"].labelled == 99 * 30
