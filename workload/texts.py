"""What a user may type in; the words are such as the documents have."""

INLINE_TEXTS = {
    "t0": "The erntesan of ouanth and the ereaat in thonst",
    "t1": "Haanth reoush <b>hewh</b> and onon   hahehe; ing that of",
    "t2": "zu der und enüchen bever ist, éaux de la quech",
    "t3": "",
}
