import json

from formweave.sources import dictionary


def test_cells_of_overall_ocr_results(spark):
    under = {"rec_texts": ["Name", " ", "Ann"], "rec_scores": [0.9, 0.1, 0.8], "rec_boxes": [[1, 2, 3, 4], [0, 0, 0, 0], [5, 6, 7, 8]]}
    top = {"rec_texts": ["Top"], "overall_ocr_res": under}
    payloads = [
        (1, {"overall_ocr_res": under}), (2, {"res": {"rec_texts": [], "rec_boxes": [], "overall_ocr_res": under}}), (3, top),
        (4, {"overall_ocr_res": {"rec_texts": ["A"], "rec_polys": [[[1, 1], [4, 1], [4, 3], [1, 3]]]}}), (5, {"rec_boxes": [[9, 9, 10, 10]], "overall_ocr_res": {"rec_texts": ["B"], "rec_boxes": [[1, 1, 2, 2]]}}),
        (6, {}), (7, {"overall_ocr_res": 3}),
    ]
    df = spark.createDataFrame([(d, json.dumps(p)) for d, p in payloads], "doc_id bigint, payload string")
    got = {(r["doc_id"], r["cell_id"]): (r["text"], r["x0"], r["y0"], r["x1"], r["y1"], r["conf"]) for r in dictionary.ocr_cells(df).collect()}
    cells = {0: ("Name", 1, 2, 3, 4, 0.9), 2: ("Ann", 5, 6, 7, 8, 0.8)}
    assert got == {**{(d, k): c for d in (1, 2) for k, c in cells.items()}, (3, 0): ("Top", 0, 0, 3, 1, None), (4, 0): ("A", 1, 1, 4, 3, None), (5, 0): ("B", 9, 9, 10, 10, None)}
