"""Small inputs with known results."""

HARBOUR_BOOK = [
    [(22, "SALT AND LANTERNS"), (13, "Letters from a Harbour Town"), (11, "by Wilma Oakenshade"), (11, "Tidemark Books")],
    [(16, "CONTENTS"), (11, "Chapter 1  Low Water"), (11, "Chapter 2  Mrs. Quill Keeps the Ledger"),
     (11, "Chapter 3  How the Bell Was Lost")],
    [(16, "Chapter 1"), (13, "Low Water"),
     (11, "At 6.40 each morning the mud flats lay bare and the gulls came"),
     (11, "down to quarrel over them. Mr. Pettigrew pushed his wheelbar-"),
     (11, "row along the shingle and counted the boats. Two of them were un-"),
     (11, "painted, and one had no name at all."),
     (11, "Dr. Sorrel kept bees behind the chandlery, i.e. where the wind"),
     (11, "could not reach them, and sold the honey by the spoon. Children"),
     (11, "queued for it on Saturdays.")],
    [(16, "Chapter 2"), (13, "Mrs. Quill Keeps the Ledger"),
     (11, "Every crate that crossed the quay went into a green book. She"),
     (11, "wrote the weights in pencil and the names in ink, since weights"),
     (11, "were argued over and names were not."),
     (11, '"A pencil forgives," Mrs. Quill liked to say. Nobody had yet'),
     (11, "seen her rub anything out.")],
    [(16, "Chapter 3"), (13, "How the Bell Was Lost"),
     (11, "The bell had hung above the customs shed since before anyone's"),
     (11, "grandmother was born, and it was rung for fog and for weddings and"),
     (11, "once, by mistake, for a cow, and when the great storm lifted the roof"),
     (11, "and carried it over the breakwater the whole town stood along the"),
     (11, "wall in nightshirts and oilskins to watch the bell swing out on its"),
     (11, "beam, ring a single time, and go down into eleven fathoms of water."),
     (11, "Divers looked for it in June. They found the cow bell.")],
]


def book_runs(doc_id, pages):
    rows = []
    for p, lines in enumerate(pages, 1):
        y, idx = 730.0, 0
        for size, text in lines:
            rows.append((doc_id, p, idx, text, float(size), 72.0, y, 0.0))
            rows.append((doc_id, p, idx + 1, "\n", float(size), 72.0, y, 0.0))
            idx += 2
            y -= round(size * 1.55)
    return rows


def case_runs(doc_id, lines):
    """One page; every line is (y, [(text, size)]) and runs have no width."""
    rows, idx = [], 0
    for y, items in lines:
        x = 50.0
        for text, size in items:
            rows.append((doc_id, 1, idx, text, float(size), x, float(y), None))
            x += len(text) * 5
            idx += 1
        rows.append((doc_id, 1, idx, "\n", 11.0, x, float(y), None))
        idx += 1
    return rows


LONG = " ".join(f"item{i}" for i in range(60)) + "."
WORD_CASES = {
    "hyphen": ([(700, [("Each lantern was care-", 11)]), (686, [("fully trimmed at dusk.", 11)])],
               ["carefully trimmed at dusk."], ["care- fully", "care-.", "care- "]),
    "size": ([(700, [("A tall ", 11), ("white", 12.4), (" mast rose above", 11)]), (686, [("the old quay.", 11)])],
             ["A tall white mast rose above the old quay."], ["above.", "above. the"]),
    "spacing": ([(700, [("Good", 11), (" ", 11), ("evening, captain.", 11)])], ["Good evening, captain."], ["Goodevening"]),
    "cap": ([(700, [(LONG, 11)])], ["item0 ", " item59."], ["ite m", "it em"]),
    "title": ([(700, [("CHAPTER 1", 16)]), (660, [("Why the Ferry Never Leaves", 11)]), (646, [("Before Noon", 11)])],
              ["Why the Ferry Never Leaves Before Noon"], ["Leaves."]),
}
