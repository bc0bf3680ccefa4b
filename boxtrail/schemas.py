"""Declared schemas of the logical tables."""

FACT = "struct<title:string,sid:int>"
TRIPLE = "struct<entity:string,relation:string,value:string>"
HOP = (
    "struct<entity:string,screenshot:string,width:int,height:int,bboxes:array<array<int>>,"
    "sentence_ids:array<int>,image_id:string,sub_query:string>"
)

ENTITY_META = (
    "entity string, url string, screenshot_path string, html_path string, layout_path string, bboxes_path string, "
    "width int, height int, num_paragraphs int, num_layout_elements int"
)
ELEMENT = (
    "struct<tag:string,id:string,cls:string,text:string,bcr:array<int>,float:string,display:string,position:string,"
    "line_rects:array<array<int>>,src:string>"
)
LAYOUT = f"page_width int, page_height int, num_elements int, elements array<{ELEMENT}>"
SAMPLE = (
    "sample_id long, question string, answer string, type string, num_hops int, "
    f"evidence_chain array<{HOP}>, evidences array<{TRIPLE}>, candidate_screenshots array<string>, "
    "distractor_screenshots array<string>, reasoning string"
)
SLIDE_RAW = (
    "sample_id long, question string, answer string, deck_name string, deck_id string, question_type string, "
    "evidence array<struct<slide_idx:int,page:int,bboxes:array<array<double>>>>"
)
PREDICTION = (
    "idx long, question string, gold_answer string, "
    f"gold_evidence_chain array<{HOP}>, candidate_screenshots array<string>, gold_image_ids array<string>, pred_text string"
)
TRIM_MANIFEST = "file string, orig_h int, new_h int, rows_removed int, skipped boolean, orig_w int, error string"

# Result rows as written by the scorer; used to resume from earlier output.
RESULT = (
    "idx long, question string, answer string, pred_text string, answer_em int, answer_contains int, "
    "bbox_localized int, bbox_recall double, bbox_precision double, bbox_all_gt_hit int, bbox_n_gt int, "
    "bbox_n_pred int, parse_ok int, image_metric_valid int, image_hop_acc double, image_chain_order_acc int, "
    "gold_image_recall double, gold_image_precision double, gold_image_all_hit int, image_bbox_joint_recall double, "
    "image_bbox_joint_all_gt_hit int"
)
