"""Fixed values that results must agree with: vocabularies, tables, thresholds, texts."""

from decimal import Decimal

# ---- Fixed values: statuses and their order of urgency ----
PASS, REVIEW, FAIL, NOT_EVALUATED = "PASS", "REVIEW", "FAIL", "NOT_EVALUATED"
SEVERITY = {FAIL: 0, REVIEW: 1, NOT_EVALUATED: 2, PASS: 3}
STATUS_TEXT = {PASS: "PASS", REVIEW: "REVIEW", FAIL: "FAIL", NOT_EVALUATED: "NOT CHECKED"}

# ---- Fixed values: the manifest, the checks and their labels ----
MANIFEST_COLUMNS = ("filename", "brand_name", "class_type", "alcohol_content", "net_contents", "bottler", "origin_country")
APPLICATION_FIELDS = MANIFEST_COLUMNS[1:]
CHECKS = {
    "brand_name": "Brand name",
    "class_type": "Class or type",
    "alcohol_content": "Alcohol content",
    "net_contents": "Net contents",
    "net_contents_standard_of_fill": "Container size — approved sizes",
    "bottler": "Bottler or producer",
    "origin_country": "Country of origin",
    "government_warning": "Government warning wording",
    "government_warning_prefix": "Government warning heading",
    "government_warning_bold": "Government warning bold text",
    "government_warning_type_size": "Government warning type size",
}
REPORT_SUFFIXES = ("result", "application value", "we read this as", "confidence", "details")
MISSING_IMAGE = "Image not uploaded: this file is listed in the application CSV but was not uploaded."
MISSING_MANIFEST = "No matching manifest row: this image was uploaded but is not listed in the application CSV."
PROCESSING_ERROR = "This label could not be checked. Try a clear, straight-on image in better light, then run the batch again."
CANCELLED = "Not checked: the batch was stopped before this label was reached."

# ---- Fixed values: token sequences, in the order in which they are tried ----
LEGAL_SUFFIXES = ("limited liability company", "incorporated", "corporation", "company", "limited", "llc", "l l c", "inc", "ltd", "corp", "co", "plc", "llp", "lp")
ORIGIN_PREFIXES = (
    "country of origin", "product of the", "produce of", "product of", "imported from", "bottled in", "distilled in",
    "produced in", "brewed in", "vinted in", "grown in", "made in", "origin",
)
ORIGIN_PLACEHOLDERS = ("n/a", "na", "none", "-", "--", r"n\a", "not applicable", "domestic")
BOTTLER_PREFIXES = (
    "blended and bottled by", "brewed and bottled by", "brewed and canned by", "distilled and bottled by",
    "produced and bottled by", "cellared and bottled by", "vinted and bottled by", "imported and bottled by",
    "bottled by", "bottled for", "brewed by", "brewed for", "blended by", "canned by", "canned for", "cellared by",
    "distilled by", "imported by", "manufactured by", "packaged by", "packaged for", "prepared by", "produced by",
    "produced for", "vinted by", "made by",
)
APOSTROPHES = "'’ʼ"

# ---- Fixed values: class designations; ties go to the earlier class ----
BEVERAGE_KEYWORDS = {
    "beer": (
        "beer", "ale", "lager", "lager beer", "malt beverage", "malt liquor", "barley wine", "porter", "stout", "pilsner",
        "pilsener", "bock", "flavored malt beverage", "cereal beverage", "near beer",
    ),
    "wine": (
        "wine", "grape wine", "table wine", "light wine", "dessert wine", "sparkling wine", "carbonated wine", "citrus wine",
        "fruit wine", "agricultural wine", "honey wine", "mead", "rice wine", "sake", "saké", "cider", "hard cider", "perry",
        "aperitif wine", "vermouth", "retsina", "sangria", "angelica", "burgundy", "claret", "chablis", "champagne",
        "chianti", "malaga", "marsala", "madeira", "moselle", "port", "rhine wine", "hock", "sauterne", "haut sauterne",
        "sherry", "tokay", "cabernet", "merlot", "chardonnay", "pinot", "riesling", "sauvignon", "zinfandel", "syrah",
        "shiraz", "malbec", "tempranillo", "sangiovese", "grenache", "viognier", "moscato", "muscat", "prosecco",
        "rose wine", "blush wine",
    ),
    "distilled_spirits": (
        "distilled spirits", "distilled spirit", "spirits", "spirit", "neutral spirits", "grain spirits", "whiskey", "whisky",
        "bourbon", "rye whiskey", "rye whisky", "corn whiskey", "corn whisky", "malt whiskey", "malt whisky", "single malt",
        "light whiskey", "light whisky", "scotch", "vodka", "gin", "genever", "sloe gin", "rum", "cachaca", "cachaça",
        "brandy", "cognac", "armagnac", "grappa", "pisco", "applejack", "kirschwasser", "slivovitz", "agave spirits",
        "tequila", "mezcal", "mescal", "cordial", "liqueur", "creme de", "crème de", "schnapps", "absinthe", "aquavit",
        "akvavit", "soju", "baijiu", "shochu", "moonshine", "flavored spirits",
    ),
}

# ---- Fixed values: similarity bands and confidences ----
FUZZY_PASS, FUZZY_REVIEW, MATCH, MISMATCH = 90.0, 70.0, 100.0, 0.0

# ---- Fixed values: numbers on labels ----
NUMBER = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?|\.[0-9]+"
NUMBER_CANDIDATE = r"[+-]?(?:[0-9][0-9.,]*|\.[0-9][0-9.,]*)"
ABV_MARKER = r"(?:\balc(?:ohol)?\.? ?/ ?vol(?:ume)?\b\.?|\balc(?:ohol)?\.? ?by ?vol(?:ume)?\b\.?|\balcohol ?content|\babv)"
ABV_SIGNAL = r"\b(?:alc|alcohol|abv)\b"
PROOF_MARKER = r"\bproof\b"
NOT_AFTER, NOT_BEFORE = r"(?<![0-9A-Za-z.,+\-])", r"(?![0-9A-Za-z.,+\-])"
NET_UNIT = r"fl\.?\s*oz\.?|ml|millilit(?:er|re)s?|l|lit(?:er|re)s?"
ABV_RANGE, PROOF_RANGE, PROOF_TOLERANCE = (0, 100), (0, 200), Decimal("0.6")
UNIT_ML = {
    "ml": "1", "milliliter": "1", "milliliters": "1", "millilitre": "1", "millilitres": "1", "l": "1000", "liter": "1000",
    "liters": "1000", "litre": "1000", "litres": "1000", "fl oz": "29.5735295625",
}
FL_OZ_ROUNDING, FL_OZ_PRINT_STEP = Decimal("0.05"), Decimal("29.5735295625") * Decimal("0.05")

# ---- Fixed values: 27 CFR 5.65, 7.65, 4.36(b), 4.10 tolerances in percentage points ----
SPIRITS_TOLERANCE, MALT_TOLERANCE, MALT_TOLERANCE_FROM = "0.3", "0.3", "0.5"
WINE_BAND, WINE_TOLERANCE_TO_BAND, WINE_TOLERANCE_ABOVE, WINE_FROM = "14", "1.5", "1.0", "7"

# ---- Fixed values: 27 CFR 5.203(a) and 4.72(a) sizes in mL; 4.72(b) whole litres from 4 L ----
SIZES = {
    "distilled_spirits": (3750, 3000, 2000, 1800, 1750, 1500, 1000, 945, 900, 750, 720, 710, 700, 570, 500, 475, 375, 355, 350, 331, 250, 200, 187, 100, 50),
    "wine": (3000, 2250, 1800, 1500, 1000, 750, 720, 700, 620, 600, 568, 550, 500, 473, 375, 360, 355, 330, 300, 250, 200, 187, 180, 100, 50),
}
WINE_LARGE_FROM, WINE_LARGE_STEP = 4000, 1000

# ---- Fixed values: 27 CFR 16.21, 16.22 ----
WARNING_PREFIX = "GOVERNMENT WARNING:"
WARNING = (
    "GOVERNMENT WARNING: (1) According to the Surgeon General, women should not drink alcoholic beverages during pregnancy because of the risk of birth defects. "
    "(2) Consumption of alcoholic beverages impairs your ability to drive a car or operate machinery, and may cause health problems."
)
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
WARNING_TOKEN = r"[A-Za-z0-9]+|[^\w\s]"
WARNING_CUES = ("surgeon general", "pregnancy", "birth defects", "consumption", "machinery", "health problems")
BOLD_EXPECTED, TYPE_SIZE_EXPECTED = "Bold GOVERNMENT WARNING: prefix", "Compliant minimum government-warning type size"

# ---- Fixed values: what each outcome says ----
SAYS = {
    "brand_missing": "Brand text was not located, so the check was not evaluated.",
    "brand_pass": "Matches the application once case and punctuation are set aside.",
    "brand_review": "Brand wording is close but not clearly the same; agent review is required.",
    "brand_fail": "Brand wording does not match the application; agent review is required.",
    "class_missing": "Class/type text was not located, so the check was not evaluated.",
    "class_pass": "Matches the application once case and punctuation are set aside.",
    "class_review": "Class/type wording is close but not clearly the same; agent review is required.",
    "class_fail": "Class/type wording does not match the application; agent review is required.",
    "alcohol_missing": "Alcohol content was not located, so the check was not evaluated.",
    "alcohol_numeric": "A numeric ABV was not available in both values; agent review is required.",
    "alcohol_class": "The beverage class could not be mapped to an ABV tolerance.",
    "advisory": " Below 7% ABV, the FAA Act and TTB wine labeling rules do not apply; FDA labeling governs under the 27 CFR 4.10 definition of wine.",
    "net_missing": "Net contents were not located, so the check was not evaluated.",
    "fill_missing": "Net contents were not located, so the standards-of-fill check was not evaluated.",
    "fill_beer": "This check does not apply because 27 CFR Part 7 sets no standards of fill for malt beverages.",
    "fill_class": "The beverage class could not be mapped to a standards-of-fill table.",
    "bottler_missing": "Bottler text was not located or provided, so the check was not evaluated.",
    "bottler_pass": "Matches the application once case and punctuation are set aside.",
    "bottler_review": "Bottler name or address is close but differs; compare the label crop with the application.",
    "bottler_fail": "Bottler name or address does not match the application; agent review is required.",
    "origin_noted": "The application value is blank or placeholder text, so this check does not apply. Note that the label does state a country of origin; confirm whether this product is an import.",
    "origin_domestic": "Country of origin does not apply to this domestic application because the application value is blank or placeholder text.",
    "origin_missing": "Required import origin text was not located, so the check was not evaluated.",
    "origin_pass": "Matches the application once case and punctuation are set aside.",
    "origin_fail": "Country of origin does not match the import application.",
    "warning_missing": "No government warning text was found on this label. The warning is a mandatory element; if the label does carry it, this photograph was not readable enough — request a clearer image.",
    "warning_pass": "The warning wording matches the statutory text word for word.",
    "warning_spaces": "Government warning wording matches the statutory text exactly, but the reader could not resolve the spaces between words. Check the crop to confirm the label itself separates them.",
    "prefix_missing": "Government warning prefix was not located, so the check was not evaluated.",
    "prefix_pass": "The GOVERNMENT WARNING: prefix is uppercase and exact.",
    "prefix_spaces": "The prefix is uppercase and correct, but the reader could not resolve the space in GOVERNMENT WARNING. Check the crop.",
    "bold": "This was not checked because boldness is not recoverable from the extracted text; confirm bold type by eye using the crop.",
    "type_size": "This was not checked because the physical measurements needed to confirm type size are not available from a photograph. For reference, 27 CFR 16.22(b) requires type at least 1 millimeter tall for containers up to 237 mL, 2 millimeters over 237 mL up to 3000 mL (3 L), and 3 millimeters above that, with at most 40, 25, and 12 characters per inch respectively.",
    "not_completed": "This check was not completed.",
}
