from __future__ import annotations

from tesserae.sources.doccomments import doc_comments

C = '''/* ============================
 * Sprites and palettes
 * ============================ */
/**
 * Draws a sprite.
 * It may /* for now */ be clipped.
 */
int draw(int x, int y);
const char *s = "/** no comment */"; // /** nor this */
/** One line. */ void clear(void);

/**
 * A limit.
 */

#define LIMIT 16
/* plain /** not at the top */ still plain */
int undocumented(void);
/** Colours; "quoted" text and // marks stay. */
typedef struct { int r; } colour_t;
/* -- Sound -- */
/** Nothing follows that has a name. */
return 0;
/** Open to the end
 * of the file'''

ASM = '''; plain
;; Waits for the raster.
;; Twice.
.proc wait
  lda #1 ; not a doc
;; A place.
loop:
  jmp loop'''


def test_comments(spark):
    rows = [("c", k, x) for k, x in enumerate(C.split("\n"))] + [("a", k, x) for k, x in enumerate(ASM.split("\n"))] + [("n", 0, None), ("n", 1, "")]
    df = spark.createDataFrame(rows, "file string, no int, text string").repartition(5)
    got = {(r.file, r.comment): (r.first, r.text, r.kind, r.symbol, r.section) for r in doc_comments(df, "file", "no", "text").collect()}
    assert got == {
        ("c", 1): (3, "Draws a sprite.\nIt may /* for now */ be clipped.", "function", "draw", "Sprites and palettes"),
        ("c", 2): (9, "One line.", "function", "clear", "Sprites and palettes"),
        ("c", 3): (11, "A limit.", "macro", "LIMIT", "Sprites and palettes"),
        ("c", 4): (18, 'Colours; "quoted" text and // marks stay.', "type", "colour_t", "Sprites and palettes"),
        ("c", 5): (21, "Nothing follows that has a name.", None, None, None),
        ("c", 6): (23, "Open to the end\nof the file", None, None, None),
        ("a", 1): (1, "Waits for the raster.\nTwice.", "proc", "wait", ""),
        ("a", 2): (5, "A place.", "label", "loop", ""),
    }
