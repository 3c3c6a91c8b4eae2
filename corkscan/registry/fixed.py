"""Query lines used by the checks.

Fixed values: the ten keyword lines and the ten vector lines that the workload
draws from, and ten lines with words of the invented prose in ``documents``
(with words that no text has, a repeated word and an upper-case word).
"""

KEYWORD_LINES = (
    "apple pear",
    "tropical fruit",
    "citrus almond",
    "orange grapefruit",
    "full bodied",
    "citrus acidity",
    "blueberry mint",
    "beef lamb",
    "shellfish seafood",
    "vegetable fish",
)
VECTOR_LINES = (
    "vanilla and a hint of smokiness",
    "rich and sweet dessert wine with balanced tartness",
    "cherry and plum aromas",
    "right balance of citrus acidity",
    "grassy aroma with apple and tropical fruit",
    "bitter with a dry aftertaste",
    "sweet with a hint of chocolate and berry flavor",
    "acidic on the palate with oak aromas",
    "balanced tannins and dry and fruity composition",
    "peppery undertones that pairs with steak or barbecued meat",
)
DOCUMENT_LINES = (
    "the and",
    "pour les",
    "und der",
    "los para",
    "the of that",
    "zzqx nomatch",
    "License Copyright",
    "email password",
    "tion the the",
    "The",
)
