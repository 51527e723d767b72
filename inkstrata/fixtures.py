"""Hand-made rows for cases that generated documents don't hold. The same rows go to the SQL that queries are held against."""

from __future__ import annotations

TEXTS = [
    (-1, "hand", "Good morning. Welcome to the call of the third quarter of the year.\nPrepared Remarks\nCEO: Revenue grew 12 percent to $4.2 billion, and margin was 18.4%. Thank you all for that. "
                 "We carry on with our plan for the steps ahead. \"Guidance\" is unchanged; customers grew.\nQuestion-and-Answer Session\nAnalyst: What about the outlook for subscribers in 2025? "
                 "CFO - We expect 3 million more by the end of the quarter; EPS should be 2.10!\nOperator: next question please\nAnalyst: Is the guidance safe? CEO: Yes, it is, as far as we know today, and it includes FX."),
    (-2, "hand", "Operator\n\n   \nQ & A\nThanks. Good afternoon to all of you on this call today. Please go ahead."),
    (-3, "hand", "Some remarks without a heading.\nAnalyst: how is the margin in the segment? CEO: The margin declined by 50 basis points in the quarter."),
    (-4, "hand", "OPENING REMARKS by the chair, and a line so long that it is no heading at all, as it has over eighty characters\nRevenue was 5.\n\tIt grew 10% year-over-year, 'strongly'."),
    (-5, "", "One sentence only, but with a number of 40 characters or more: 12345."),
    (-6, "hand", ""),
    (-7, "hand", "A" * 30 + " " + "word " * 500 + "and 7 customers. The end came soon after that, with a margin of 3%. Then nothing;"),
    (-8, "hand", "questions and answers\nEPS, revenue; guidance,"),
]

ANSWERS = [("a1", "This is NOT IN THE CONTEXT of the call."), ("a2", "We will Update you."), ("a3", "Revenue was 5."), ("a4", ""), ("a5", None), ("a6", "I refuse.")]

_LONG = "The output has enough characters to pass the length test"
PAIRS = [
    ("h1", "c:1", "Twelve chars", "x" * 40, f"{_LONG}; citation given", ["[c:1#s0] The output has enough characters to pass the length test"]),
    ("h2", "c:2", "Eleven char", "x" * 39, "y" * 39, []),
    ("h3", "c:3", "i" * 601, "x" * 40, "y" * 4001, None),
    ("h4", "c:4", "A good instruction", "x" * 40, f"{_LONG}, see c:4", ["[d:1] other"]),
    ("h5", "", "A good instruction", "x" * 40, f"{_LONG}; [d:5 is here", ["[d:5] something else that is long enough to be cut at 48 characters"]),
    ("h6", "c:6", "A good instruction", "x" * 40, f"{_LONG}; sources", ["[d:6] nothing"]),
    ("h7", "c:7", " \t ", None, None, ["no bracket at all"]),
    ("h8", "c:8", "A good instruction", "x" * 40, f"{_LONG}; chunk_ 1", ["[d:8]"]),
    ("h9", "C:9", "A good instruction", "x" * 40, f"{_LONG}; from c:9", ["[q] zzz", "[r] The output has enough"]),
]

PANEL = [
    ("p1", "Revenue was $4.12B, up 8% over last year. Margin 18.4%.", ["$4.12B", "18.4%"], False, "[dry-run] nothing", "Revenue of $4.12b rose 8%; margin was 18.4%."),
    ("p2", "Cash flow was $610 million.", [], True, "It is not stated in the text.", "Free cash flow was $470 million."),
    ("p3", "We will discuss it next month.", ["month", "", "year"], True, "I don't know", "That is not provided; will update next month"),
    ("p4", "", ["x"], False, "", ""),
    ("p5", "Units grew 3.5% to 1,200.", [], False, "3.5%", "Units: 1,200 (3.5%)"),
]

#: Lines of a chunk file: what is missing, empty or null gets a default; blank lines are passed over.
LINES = [
    '{"chunk_id": "c1", "source_id": "s", "section": "qa", "text": "One.", "start_sentence": 2, "end_sentence": 3, "propositions": [{"text": "One.", "source_sentence_index": 0, "score": 0.5}], "metadata": {"a": "b"}}',
    "", '{"text": "Two."}', "   ", '{"chunk_id": "", "source_id": null, "section": "", "text": null, "start_sentence": 7}', '{"chunk_id": "c4", "text": "Four", "extra": {"x": 1}, "propositions": []}',
]
