import numpy as np
from pyspark.sql import functions as F

from fitloom.plans.intake import score_uploads

KB = "key string, occupation string, core_skills array<struct<item:string,weight:double>>, optional_skills array<struct<item:string,weight:double>>, embedding array<float>"


def test_uploads_to_scores(spark):
    kb = spark.createDataFrame([("web", "Web", [("SQL", 0.9), ("React.js", 0.6)], [("Docker", 0.2)], [0.5, 0.5])], KB)
    rows = [(1, "a.pdf", 100, "We use ReactJS and <b>sql</b>", "web", 7), (2, "b.txt", 100, "sql", "web", 8), (3, "c.pdf", 0, "sql", "web", 9),
            (4, "d.pdf", 100, "sql", "ops", 10), (5, "e.docx", 100, "  ", "web", 11), (6, "f.docx", 100, "bad vector", "web", 12),
            (None, "g.pdf", 100, "sql", "web", 13), (8, "h.PDF", 10**9, "sql", "web", 14)]
    uploads = spark.createDataFrame(rows, "doc_id long, filename string, n_bytes long, body string, target_key string, user_id long")
    encoder = lambda: (lambda texts: np.array([[np.nan, 1.0] if "bad" in t else [1.0, 1.0] for t in texts]))
    out = score_uploads(uploads, kb, F.lit("2024-01-01 00:00:00"), encoder)
    status = {r.filename: (r.status, r.reason) for r in out.status.collect()}
    assert status == {"a.pdf": (200, None), "b.txt": (415, None), "c.pdf": (400, None), "d.pdf": (404, None), "e.docx": (422, None),
                      "f.docx": (200, "vector"), "g.pdf": (200, "id"), "h.PDF": (413, None)}
    (score,) = out.scores.collect()
    assert (score.doc_id, score.user_id, score.cv_filename, score.occupation_display) == (1, 7, "a.pdf", "Web")
    assert score.matched_skills == ["SQL", "React.js"] and score.missing_skills == ["Docker"]
    (saved,) = out.history.collect()
    assert (saved.occupation_key, saved.user_id, saved.match_score) == ("web", 7, score.match_score)
    none = score_uploads(uploads.filter("n_bytes < 0"), kb, F.lit("2024-01-01 00:00:00"), encoder)
    assert none.status.count() == none.scores.count() == none.history.count() == 0
