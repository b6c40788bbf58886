"""Fixed values of the retrieval and metering rules."""

BM25_K1, BM25_B = 1.2, 0.75
NGRAM = 3
RRF_K = 12
RRF_WEIGHTS = (0.5, 0.5)
FUZZY_ACCEPT, FUZZY_WEIGHT, FUZZY_DISTANCE = 0.72, 0.9, 2
CHUNK_SIZE, CHUNK_OVERLAP = 20, 2
FRAGMENT_SMALL, FRAGMENT_MEDIUM, MEDIUM_BYTES = (5, 2), (10, 4), 7000
SCENE_WIDTH = 7
SLICE_SPAN, SLICE_MARGIN, SLICE_WIDTH, SLICES_PER_SEARCH = 32, 6, 48, 2
GROUP_PARAGRAPHS = 4
SEGMENT_TOKENS, CHARS_PER_TOKEN = 60_000, 4
