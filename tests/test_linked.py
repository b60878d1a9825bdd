from quarry.sources import linked as L


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_full_text_and_label_sections(spark):
    rows = frame(spark, L.JATS, ("1", "Abs  tract", ([("Intro <i>x</i>", ["One ", ""]), (None, ["Two"])],)), ("2", "only", None))
    assert [(r.id, r.text) for r in L.jats_full_text(rows).collect()] == [("1", "## Abstract\nAbs tract\n\n\n## Intro x\n\nOne\nTwo")]
    got = L.label_sections(frame(spark, "set_id string, code string, position int, text string", ("s", "34071-1", 2, "later"), ("s", "34071-1", 1, "<b>first</b>"), ("s", "0", 0, "other"), ("s", "34089-3", 5, "w" * 900))).collect()
    assert {(r.field, r.text) for r in got} == {("warnings", "first"), ("description", "w" * 500)}


def test_children_and_priorities(spark):
    mols = frame(spark, "molecule_chembl_id string, pref_name string", ("C1", "ASPIRIN"), ("C2", None))
    mech = frame(spark, "molecule_chembl_id string, position int, mechanism_of_action string, action_type string, target_chembl_id string", *(("C1", k, f"m{k}", "INHIBITOR" if k else None, None) for k in range(7)))
    ind = frame(spark, "molecule_chembl_id string, position int, mesh_heading string, efo_term string, max_phase_for_ind string", ("C1", 0, None, None, "4"))
    warn = frame(spark, "molecule_chembl_id string, position int, warning_type string, warning_class string, warning_description string, warning_year int, warning_country string", ("C1", 0, "W", "c", "d", 1999, "US"))
    got = L.molecules(mols, mech, ind, warn).collect()
    assert len(got) == 1 and got[0].content == "Molecule: ASPIRIN\n## Mechanisms\n- m0\n- m1 (INHIBITOR)\n- m2 (INHIBITOR)\n- m3 (INHIBITOR)\n- m4 (INHIBITOR)\n## Indications\n- Unknown (phase 4)\n## Warnings\n- W (c): d [1999] [US]"
    rows = frame(spark, "topic_id long, pref_name string, max_phase string, arrival long", (1, None, "4", 0), (1, "B", "4", 1), (1, "a", None, 2), (1, "C", "x", 3), (2, None, None, 4))
    assert [(r.topic_id, r.arrival) for r in sorted(L.molecule_priority(rows, "A").collect(), key=lambda r: (r.topic_id, r.place))] == [(1, 2), (1, 1), (1, 3), (2, 4)]


def test_entities_vocabulary_and_papers(spark):
    hits = frame(spark, "id string, name string, entity string, description string", ("1", "D", "drug", None), ("2", "T", "target", "t"), ("3", "E", "drug", "e"))
    got = {r.url: r.content for r in L.platform_entities(hits, frame(spark, "id string, text string", ("1", "rich"))).collect()}
    assert got == {"https://platform.opentargets.org/drug/1": "rich", "https://platform.opentargets.org/target/2": "Target: T\nID: 2\n\nt", "https://platform.opentargets.org/drug/3": "Drug: E\nID: 3\n\ne"}
    related = frame(spark, "concept string, kind string, label string, position int", ("c", "ingredient", "ing", 1), *(("c", "brand", f"b{k}", k) for k in range(7)))
    names = L.drug_vocabulary(frame(spark, "name string", ("x",), ("y",)), frame(spark, "name string, concept string", ("x", "c")), related)
    assert sorted((r.name, r.ingredient, r.brands, r.matched) for r in names.collect()) == [("x", "ing", ["b0", "b1", "b2", "b3", "b4"], True), ("y", "y", [], False)]
    papers = frame(spark, L.PAPERS, ("T", None, ("10.1/x",), 2001, "ab", 3), ("U", None, None, None, None, None))
    assert [(r.url, r.content) for r in L.citation_papers(papers).collect()] == [("https://doi.org/10.1/x", "Title: T\nYear: 2001\nCitations: 3\n\nAbstract: ab")]


def test_crosswalk_facts_and_gold(spark):
    links = frame(spark, "pmid string, linkname string, pmcid string, position int", ("1", "pubmed_pmc_local", "L", 0), ("1", "pubmed_pmc", "P2", 1), ("1", "pubmed_pmc", "P1", 0), ("2", "pubmed_pmc_refs", "R", 0))
    assert [(r.pmid, r.pmcid) for r in L.full_text_ids(links).collect()] == [("1", "P1")]
    facts = frame(spark, "indicator string, country string, year int, value double, arrival int", *(("i", f"c{k % 7}", 2000 + k, 1.0, k) for k in range(70)))
    got = {r.country: r.facts for r in L.indicator_facts(facts).collect()}
    assert set(got) == {f"c{k}" for k in range(5)} and got["c0"].startswith("2063: 1.0; 2056: 1.0") and got["c0"].count(";") == 4
    ev = frame(spark, "claim int, doc int, label string", (1, 1, "SUPPORT"), (1, 1, "SUPPORT"), (1, 2, None), (2, 1, "SUPPORT"), (2, 1, "CONTRADICT"), (3, 1, None))
    assert {(r.claim, r.doc, r.label) for r in L.gold_labels(ev).collect()} == {(1, 1, "SUPPORT"), (1, 2, "NOINFO"), (2, 1, "NOINFO"), (3, 1, "NOINFO")}
    assert {(r.claim, r.label) for r in L.claim_labels(ev).collect()} == {(1, "SUPPORT"), (3, "NOINFO")}
