"""Character classes, as parts of regular expressions (code points, read alike by all engines used)."""

#: Ideographs: unified, extension A, compatibility, and Bopomofo.
HAN = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{3105}-\x{312F}"
#: Ideographs, CJK punctuation but for the ideographic space, and full-width forms.
CONTEXT = HAN + r"\x{3001}-\x{303F}\x{FF01}-\x{FF60}"
#: Fixed value: what a URL is; its scheme is bounded, so that a run of letters is read in linear time.
URL = r"[a-zA-Z0-9+.\-]{0,32}://[^\s「」『』《》]+"
#: Ends of sentences.
ENDS = "。！？；"
#: Stands for each character that a mask covers: of private use, and in no class that a detector looks for.
MASKED = "\ue000"
