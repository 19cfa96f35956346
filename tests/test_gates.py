import json

from deckmill.operators import checks, gates
from tests.test_projection import GOOD


def test_noise_and_selection(spark):
    box = "deck_id int, slide_number int, asset_id string, x double, y double, w double, h double"
    placed = spark.createDataFrame([(1, 1, "logo", 0.0, 0.0, 0.1, 0.1), (1, 2, "logo", 0.0, 0.0, 0.1, 0.1), (1, 1, "bg", 0.0, 0.0, 1.0, 1.0), (1, 2, "bg", 0.0, 0.0, 1.0, 1.0), (1, 1, "chart", 0.2, 0.2, 0.5, 0.5), (1, 1, "dot", 0.5, 0.5, 0.05, 0.05), (1, 1, "role", 0.2, 0.2, 0.5, 0.5), (1, 1, "mark", 0.9, 0.9, 0.1, 0.1)], box)
    texts = spark.createDataFrame([(1, "chart", "many words", 20, "verified", 0.9), (1, "mark", "Brand X of the year", 9, "verified", 0.3)], "deck_id int, asset_id string, text string, n_words int, status string, confidence double")
    edges = spark.createDataFrame([(1, "chart", 2)], "deck_id int, asset_id string, n_edges int")
    roles = spark.createDataFrame([(1, "role", "logo")], "deck_id int, asset_id string, role string")
    noise = gates.noise_reasons(placed, texts, edges, roles)
    got = {r.asset_id: r.reasons for r in noise.collect()}
    assert got == {
        "logo": ["repeated_small_corner_asset", "decorative_or_logo_asset"], "bg": ["repeated_full_slide_template_asset"], "chart": [], "dot": ["tiny_low_information_asset"], "role": ["deterministic_role_noise"],
        "mark": ["recognized_logo_or_watermark_text"],
    }
    graphs = spark.createDataFrame([(1, "chart", 2, 0.0, "unknown")], "deck_id int, asset_id string, n_edges int, verified_share double, direction string")
    none = edges.where("deck_id < 0")
    s = {r.asset_id: (r.selected, r.reasons) for r in gates.selected(noise, texts, graphs, edges, none).collect()}
    assert s["chart"] == (True, ["diagram_edges_missing", "diagram_flow_direction_unclear", "native_visual_disagreement"]) and s["dot"] == (False, ["noise_filtered", "tiny_low_information_asset"])


def test_what_a_model_is_told(spark):
    rows = [(1, 1, f"o{i:03d}", None, "text", "t" * (600 if i == 0 else 1), 0.0, 0.0, 1.0, 1.0, i) for i in range(120)] + [(1, 1, "g", None, "group", None, 0.0, 0.0, 1.0, 1.0, 0)]
    c = json.loads(gates.told(spark.createDataFrame(rows, "deck_id int, slide_number int, object_id string, parent_id string, type string, text string, x double, y double, w double, h double, z_order int")).first().context)
    assert len(c) == 96 and c[0]["object_id"] == "o000" and len(c[0]["text"]) == 503 and c[95]["object_id"] == "o095"


def test_conservative_answers_and_grounding(spark):
    node = lambda i, label, box=(0.3, 0.3, 0.1, 0.1): {"id": i, "label": label, "bbox": list(box), "status": "verified"}
    edge = lambda s, t: {"source": s, "target": t, "label": "", "direction": "unknown", "status": "verified"}
    answer = GOOD | {"flow_present": False, "nodes": [node("a", "Seat map"), node("b", "Depot gate"), node("c", "Page 12"), node("d", "Brand X", (0.0, 0.3, 0.1, 0.1)), node("e", "Brand study")], "edges": [edge("a", "b"), edge("a", "c"), edge("b", "e")]}
    a = checks.vision_errors(spark.createDataFrame([(1, json.dumps(answer)), (2, json.dumps(GOOD | {"image_role": "logo"})), (3, "no json")], "k int, response string"))
    got = {r.k: r for r in gates.conservative(a).collect()}
    assert ([n.id for n in got[1].answer.nodes], {n.status for n in got[1].answer.nodes}) == (["a", "b", "e"], {"partial"})
    assert [(e.source, e.target, e.status) for e in got[1].answer.edges] == [("a", "b", "unverified"), ("b", "e", "unverified")] and got[1].answer.flow_present is None
    assert (got[1].n_noise_nodes, got[1].n_lost_edges, got[1].n_downgraded) == (2, 1, 3) and got[1].answer.observations[-1].objects == ["c", "d"]
    assert got[2].answer.nodes == [] and got[2].n_noise_nodes == 2 and got[3].answer is None
    assert {n.status for n in gates.conservative(a, keep_status=True).where("k = 1").first().answer.nodes} == {"verified"}
    context = spark.createDataFrame([(1, ["e"], ["The  SEAT map of today", "x"])], "k int, ids array<string>, texts array<string>")
    g = {r.k: r for r in gates.grounding(gates.conservative(a), context, ["k"]).collect()}
    assert (g[1].n_nodes, g[1].n_grounded, g[1].node_score, g[1].edge_score, g[1].checks) == (3, 2, 0.666667, 0.0, ["ungrounded_node_claim", "ungrounded_edge_claim"])
    assert (g[2].node_score, g[2].checks) == (1.0, []) and g[3].node_score == 1.0
