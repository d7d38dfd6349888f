"""Domain values. Every operator takes them as parameters; these are the defaults."""

# ---- fixed values: they have to equal the published data model ----------------

GRADES = ("a", "b", "c", "d", "e")

GRADE_LABELS = {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4}

PRODUCT_COLUMNS = (
    "code", "product_name", "brands", "categories_en",
    "countries_en", "ingredients_text",
    "nutriscore_score", "nutriscore_grade", "nova_group",
    "energy_100g", "fat_100g", "saturated_fat_100g",
    "carbohydrates_100g", "sugars_100g", "fiber_100g", "proteins_100g", "salt_100g",
    "additives_n", "additives_tags", "image_url",
)

NUTRIENTS = (
    "energy_100g", "fat_100g", "saturated_fat_100g", "carbohydrates_100g",
    "sugars_100g", "fiber_100g", "proteins_100g", "salt_100g",
)

FEATURES = NUTRIENTS + ("additives_n",)

COMPARED_SHAPE = (
    "energy_100g", "fat_100g", "sugars_100g", "fiber_100g", "proteins_100g", "salt_100g",
)

DEFAULT_BRAND = "Inconnu"
DEFAULT_CATEGORY = "Uncategorized"
UNKNOWN_BRAND = "Marque inconnue"
UNKNOWN_GRADE = "Inconnu"

REGION_PATTERN = "france|belgium|switzerland|canada"

ALLERGENS = {
    "Gluten": ["gluten", "wheat", "farine de blé", "blé", "orge", "seigle"],
    "Lactose": ["lait", "milk", "lactose", "beurre", "crème", "fromage"],
    "Fruits à coque": ["noix", "amande", "noisette", "cajou", "pistache", "noix de coco"],
    "Arachides": ["arachide", "cacahuète", "peanut"],
    "Soja": ["soja", "soy"],
    "Oeufs": ["oeuf", "egg"],
    "Poisson": ["poisson", "fish", "saumon", "thon", "cabillaud"],
    "Céleri": ["céleri", "celery"],
}

THEMES = {
    "grade": ["nutriscore", "nutri-score", "nutri score", "score"],
    "additives": ["additif", "additifs", "e100", "colorant", "conservateur"],
    "sugar": ["sucre", "sucres", "glucide", "glucides"],
    "salt": ["sel", "sodium", "hypertension"],
    "protein": ["proteine", "protéine", "protéines", "proteines"],
    "substitution": ["alternative", "remplacer", "substitut", "plus sain", "meilleur"],
    "fibre": ["fibre", "fibres"],
}

GRADE_DESCRIPTIONS = {
    "a": "Excellent — Très sain ✅",
    "b": "Bon — Bonne qualité nutritionnelle 👍",
    "c": "Moyen — À consommer avec modération ⚠️",
    "d": "Médiocre — Qualité nutritionnelle faible 👎",
    "e": "Mauvais — À éviter ❌",
}

# Texts of the context block; figures as (measure, digits, label, unit).
CONTEXT_WORDS = {
    "size": " produits | Distribution : ",
    "found": "\nPRODUITS TROUVÉS DANS LA BASE :\n",
    "item": "  • ",
    "grade": ") — Nutri-Score ",
    "figures": (
        ("energy_100g", 0, "    Énergie: ", " kcal"),
        ("sugars_100g", 1, " | Sucres: ", "g"),
        ("salt_100g", 2, " | Sel: ", "g"),
        ("fat_100g", 1, " | Graisses: ", "g"),
        ("proteins_100g", 1, " | Protéines: ", "g"),
    ),
    "additives": " | Additifs: ",
}

BOOSTING = {
    "max_iter": 200,
    "max_depth": 6,
    "step_size": 0.1,
    "subsample": 0.8,
    "feature_subset": "0.8",
}

SPLIT_SHARE = 0.2
SPLIT_SEED = 42
TEXT_SAMPLE = 30_000
MIN_TRAIN_TEXT = 10
MIN_QUERY_TEXT = 5

STREAM_TOPIC = "off-products"
JDBC_BATCH = 1000

# ---- end of fixed values -------------------------------------------------------

# Rows that a caller may fit a model on, instead of all.
FIT_ROWS = 20_000

# The hyphenated source name needs back-ticks in SQL, so it is renamed when read.
SOURCE_NAMES = {"saturated_fat_100g": ("saturated-fat_100g", "saturated_fat_100g")}
# The regional dump may carry energy twice; kilocalories win.
REGION_SOURCE_NAMES = {
    **SOURCE_NAMES,
    "energy_100g": ("energy-kcal_100g", "energy_100g"),
}
