"""Explicit schemas of everything that is read from JSON (inferring would turn fact maps into structs)."""

TURN = "turn_id int, utterance string, resolved_utterance string, response string, ptkb_provenance array<int>, response_provenance array<string>"
TOPIC = f"number string, title string, ptkb map<string,string>, turns array<struct<{', '.join(c.replace(' ', ':', 1) for c in TURN.split(', '))}>>"
FLAT_TURN = (
    "sample_id string, number string, title string, cur_utt_text string, oracle_utt_text string, cur_response_text string, ptkb map<string,string>, "
    "ptkb_provenance array<int>, response_provenance array<string>, ctx_utts_text array<string>, history_response array<string>, "
    "LLM_select string, rewrite_utt_text string, response_utt_text string, id string, output string"
)
PASSAGE = "id string, contents string"
BATCH_RESPONSE = "custom_id string, response struct<body:struct<choices:array<struct<message:struct<content:string>>>>>"
METRICS = ("MRR", "NDCG@3", "NDCG@5", "NDCG@1000", "Precision@20", "Recall@20", "Recall@1000", "MAP")
