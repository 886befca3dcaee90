"""Default lookup values.  Every operator takes its lexicon as a parameter; these are the defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

# Aspect keywords (English and Malay/Indonesian).
ASPECTS: dict[str, list[str]] = {
    "service": ["service", "staff", "waiter", "waitress", "employee", "manager", "owner", "customer service",
                "hospitality", "friendly", "rude", "attentive", "helpful", "pelayanan", "pegawai", "karyawan"],
    "price": ["price", "expensive", "cheap", "affordable", "overpriced", "worth", "value", "cost", "murah",
              "mahal", "harga", "terjangkau"],
    "quality": ["quality", "taste", "delicious", "tasty", "fresh", "good", "excellent", "terrible", "bad",
                "amazing", "wonderful", "perfect", "enak", "lezat", "segar", "buruk", "bagus"],
    "ambiance": ["ambiance", "atmosphere", "decor", "interior", "design", "vibe", "music", "noise", "noisy",
                 "quiet", "clean", "dirty", "crowded", "cozy", "comfortable", "suasana", "tempat", "bersih",
                 "kotor", "ramai", "nyaman"],
    "location": ["location", "parking", "access", "traffic", "distance", "area", "neighborhood",
                 "lokasi", "parkir", "akses", "dekat", "jauh"],
    "wait_time": ["wait", "waiting", "queue", "line", "slow", "fast", "quick", "long", "minutes", "hours",
                  "tunggu", "lama", "cepat", "antri", "antrian"],
    "menu_variety": ["menu", "variety", "choice", "options", "selection", "vegan", "vegetarian",
                     "halal", "pilihan", "variasi", "menu makanan"],
    "portion": ["portion", "size", "small", "large", "big", "porsi", "besar", "kecil"],
    "delivery": ["delivery", "takeout", "takeaway", "pickup", "online", "order", "grab", "gojek",
                 "pesan", "antar", "bungkus"],
}

# Recommendation title and actions per aspect.
RECOMMENDATIONS: dict[str, tuple[str, list[str]]] = {
    "service": ("Improve Staff Service Quality", [
        "Implement regular customer service training for staff",
        "Set up a feedback system to track staff performance",
        "Consider mystery shopper programs to audit service quality",
        "Establish clear service standards and response protocols"]),
    "price": ("Review Pricing Strategy", [
        "Benchmark prices against top competitors in the area",
        "Create value meal/package options for budget-conscious customers",
        "Clearly communicate price-value proposition on menu/listings",
        "Consider loyalty programs or discounts for repeat customers"]),
    "quality": ("Enhance Product/Service Quality", [
        "Audit current quality control processes",
        "Source higher-quality ingredients/materials",
        "Implement quality checkpoints before serving/delivering",
        "Gather real-time quality feedback from customers"]),
    "ambiance": ("Upgrade Atmosphere & Environment", [
        "Assess cleanliness and maintenance schedules",
        "Consider interior design improvements or renovation",
        "Manage noise levels and music selection",
        "Ensure comfortable temperature and lighting"]),
    "location": ("Address Location & Accessibility Issues", [
        "Improve signage and directions to the location",
        "Partner with nearby parking facilities or add valet service",
        "Highlight accessibility features on online listings",
        "Consider offering delivery/pickup if not already available"]),
    "wait_time": ("Reduce Wait Times", [
        "Implement online ordering/reservation system",
        "Optimize kitchen/fulfillment workflow",
        "Add staff during peak hours",
        "Provide estimated wait times and comfortable waiting area"]),
    "menu_variety": ("Expand Menu/Product Variety", [
        "Survey customers about desired menu items/products",
        "Add seasonal or limited-time offerings",
        "Include dietary-specific options (vegan, gluten-free, halal)",
        "Rotate menu items to keep offerings fresh"]),
    "portion": ("Adjust Portion Sizes", [
        "Review portion sizes against customer expectations",
        "Offer multiple size options (small/regular/large)",
        "Ensure consistency in portioning across all orders",
        "Consider combo/family-size options for groups"]),
    "delivery": ("Improve Delivery & Takeout Experience", [
        "Partner with reliable delivery platforms",
        "Improve packaging to maintain food/product quality during transit",
        "Set accurate delivery time estimates",
        "Implement order tracking for customers"]),
}

# Word-count buckets as (upper bound, label); a count above the last bound has none.
LENGTH_BUCKETS: list[tuple[int, str]] = [
    (10, "very_short"), (30, "short"), (50, "medium"), (100, "long"), (500, "very_long"),
    (10000, "extremely_long"),
]

# Severity of a complaint by its share of the negative reviews (lower bound, label).
COMPLAINT_SEVERITY = [(20, "critical"), (10, "high"), (5, "medium")]
# The three-level severity of the priority cards.
PRIORITY_SEVERITY = [(20, "critical"), (10, "high")]
# Alert level by the overall negative share.
ALERT_LEVELS = [(25, "critical"), (15, "high"), (8, "medium")]
# Health label by positive minus negative share.
HEALTH_LABELS = [(30, "healthy"), (10, "moderate")]
SEVERITY_ORDER = ["critical", "high", "medium", "low"]

SENTIMENTS = ["positive", "neutral", "negative"]

# Frequent Malay/Indonesian function words, added to the English list that ships with Spark ML.
MALAY_INDONESIAN_STOP_WORDS: list[str] = (
    "ada adalah agar akan aku anda antara apa apabila atau atas bagi bahawa bahwa banyak baru beberapa "
    "belum bisa boleh bukan dalam dan dapat dari daripada dengan di dia hanya harus hingga ia ialah ini "
    "itu jadi jika juga kalau kami kamu karena ke kemudian kepada kerana ketika kita lagi lain lalu lebih "
    "maka masih mereka oleh pada paling para pasti perlu pernah pula pun saat saja sama sambil sampai "
    "sangat saya sebab sebagai sebelum sebuah secara sedang sehingga sejak sekali selalu semua seperti "
    "serta sesudah setelah setiap suatu sudah supaya tanpa tapi telah tentang tersebut tetapi tiap tidak "
    "untuk walau yaitu yang"
).split()

# Published valence-rule constants (Hutto & Gilbert 2014).
BOOST = 0.293
CAPS_BOOST = 0.733
NEGATION_FACTOR = -0.74
NORMALISATION = 15.0

# Words that flip the polarity of the next words.  The contracted forms follow by rule: each
# auxiliary + "n't", with and without the apostrophe.
_CONTRACTED = ("ai are ca could did does do had has have is might must need ought sha should was were "
               "wo would dare").split()
NEGATORS: list[str] = sorted(
    {a + "n't" for a in _CONTRACTED} | {a + "nt" for a in _CONTRACTED}
    | set("cannot neither never none nope nor not nothing nowhere uhuh without despite rarely seldom".split())
)

# Degree words: +1 strengthens the following sentiment word, -1 weakens it.
_STRONGER = (
    "absolutely amazingly awfully completely considerably decidedly deeply effing enormously entirely "
    "especially exceptionally extremely fabulously flipping fricking frigging fully greatly hella highly "
    "hugely incredibly intensely majorly more most particularly purely quite really remarkably so "
    "substantially thoroughly totally tremendously uber unbelievably unusually utterly very"
).split()
_WEAKER = ("almost barely hardly kinda less little marginally occasionally partly scarcely slightly "
           "somewhat sorta").split()
BOOSTERS: dict[str, float] = {**{w: BOOST for w in _STRONGER}, **{w: -BOOST for w in _WEAKER}}

# A small English and Malay/Indonesian valence list (-4..4), so that the library scores reviews
# without a download.  Callers with a full published list pass it as a mapping instead.
VALENCES: dict[str, float] = {
    "amazing": 2.8, "awesome": 3.1, "bad": -2.5, "beautiful": 2.9, "best": 3.2, "clean": 1.7,
    "comfortable": 1.5, "delicious": 2.7, "dirty": -1.9, "disappointed": -2.1, "disappointing": -2.2,
    "disgusting": -2.4, "excellent": 2.7, "fantastic": 2.6, "fresh": 1.3, "friendly": 2.2, "good": 1.9,
    "great": 3.1, "happy": 2.7, "hate": -2.7, "helpful": 1.8, "horrible": -2.5, "love": 3.2, "nice": 1.8,
    "perfect": 2.7, "poor": -2.1, "recommend": 1.5, "recommended": 0.8, "rude": -2.0, "terrible": -2.1,
    "wonderful": 2.7, "worst": -3.1, "wrong": -2.1,
    "bagus": 1.9, "buruk": -2.5, "enak": 2.4, "kecewa": -2.1, "kotor": -1.9, "lezat": 2.7, "mantap": 2.6,
    "nyaman": 1.5, "ramah": 2.2,
}

# Search-term packs and areas for query generation.
NICHES: dict[str, list[str]] = {
    "fnb": ["restaurant", "cafe", "kopitiam", "kedai makan", "mamak",
            "nasi kandar", "coffee shop", "bakery", "western food", "bubble tea"],
    "automotive": ["car workshop", "kedai kereta", "tyre shop", "car wash",
                   "car detailing", "motorcycle workshop", "car service centre",
                   "bengkel kereta", "car battery shop", "car aircond service"],
    "beauty": ["hair salon", "barbershop", "kedai gunting rambut", "spa",
               "massage", "beauty salon", "facial", "nail salon", "urut"],
    "hotel": ["hotel", "homestay", "budget hotel", "guest house", "resort"],
    "retail": ["mini market", "grocery store", "pharmacy", "hardware shop",
               "pet shop", "mobile phone shop"],
    "education": ["tuition centre", "tadika", "kindergarten", "daycare",
                  "driving school", "music school"],
    "fitness": ["gym", "fitness centre", "badminton court", "futsal court",
                "yoga studio"],
    "services": ["laundry", "dobi", "aircond service", "renovation contractor",
                 "printing shop", "photography studio"],
}
CLINIC_KEYWORDS: list[str] = [
    "clinic", "klinik", "hospital", "medical clinic", "doctor", "dental clinic", "klinik gigi",
    "klinik kesihatan", "pharmacy", "health clinic", "klinik 24 jam", "specialist clinic",
    "klinik pakar", "family clinic", "klinik keluarga", "medical centre", "pusat perubatan",
    "child specialist clinic", "klinik kanak kanak", "women clinic", "klinik wanita",
    "physiotherapy", "fisioterapi", "diagnostic centre", "pusat diagnostik",
]
AREAS: list[str] = [
    "Cyberjaya", "Putrajaya", "Dengkil", "Bangi", "Kajang", "Seri Kembangan", "Puchong", "Serdang",
    "Bandar Baru Bangi", "Sepang", "Putra Heights", "Subang Jaya",
]
# Centres of the geo-targeted searches, as written in the query text.
GEO_CENTRES: list[str] = [
    "2.9221,101.6514", "2.9313,101.6879", "2.8730,101.6874", "2.9031,101.7870",
    "2.9930,101.7890", "3.0063,101.7066", "3.0253,101.6178", "2.9761,101.7000",
]


def default_stop_words(spark: SparkSession) -> list[str]:
    """English from Spark ML plus the Malay/Indonesian list above."""
    from pyspark.ml.feature import StopWordsRemover

    english = StopWordsRemover.loadDefaultStopWords("english")
    return sorted(set(english) | set(MALAY_INDONESIAN_STOP_WORDS))



def recommendation_table(
    spark: SparkSession, templates: Mapping[str, tuple[str, Sequence[str]]] = RECOMMENDATIONS
) -> DataFrame:
    rows = [(aspect, title, list(actions)) for aspect, (title, actions) in templates.items()]
    return spark.createDataFrame(rows, "aspect string, title string, actions array<string>")
