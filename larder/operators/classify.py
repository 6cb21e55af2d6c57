"""Dish archetypes, sections and pictures by ordered rules, compiled to one CASE each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Archetypes and their patterns over lower-case names; the first that is found holds.
ARCHETYPES = (
    ("milkshake", r"milkshake|\bshake\b|\bmalt\b|frosted lemonade|frosted coffee"),
    ("ice-cream", r"ice cream|icedream|sundae|\bcone\b|blizzard|frosty|mcflurry|soft serve|float\b"),
    ("iced-coffee", r"frappuccino|frappe|iced coffee|cold brew|iced latte|iced mocha"),
    ("coffee", r"coffee|latte|cappuccino|americano|espresso|macchiato|mocha|\bbrew\b"),
    ("tea", r"\btea\b|chai|matcha"),
    ("slush", r"slurpee|slush|icee|freeze\b|frozen (drink|carbonated)"),
    ("smoothie", r"smoothie|refresher"),
    ("juice", r"juice|lemonade|orange drink|apple drink"),
    ("soda", r"coca[- ]cola|coke\b|pepsi|sprite|dr pepper|root beer|mountain dew|fanta|soda\b|fountain|barq|mello yello|sierra mist|soft drink"),
    ("water", r"\bwater\b|dasani|aquafina|smartwater"),
    ("milk", r"\bmilk\b(?! ?shake)|chocolate milk"),
    ("beer", r"\bbeer\b|\bale\b|lager|\bipa\b"),
    ("cocktail", r"margarita|sangria|mojito|martini|cocktail|daiquiri|long island"),
    ("wine", r"\bwine\b|chardonnay|merlot|cabernet"),
    ("cheeseburger", r"cheeseburger|quarter pounder|big mac|whopper|baconator|double cheese|bacon burger"),
    ("hamburger", r"\bburger\b|hamburger|patty melt|slider"),
    ("chicken-sandwich", r"chicken sandwich|chicken deluxe|spicy (deluxe|sandwich)|chicken filet|mcchicken|chicken club|grilled chicken sandwich"),
    ("chicken-nuggets", r"nugget|popcorn chicken|chicken bite"),
    ("chicken-strips", r"\bstrip\b|strips\b|tender|chick n strips"),
    ("chicken-wings", r"\bwing\b|wings\b|boneless wing"),
    ("fried-chicken", r"fried chicken|drumstick|chicken thigh|chicken breast|crispy chicken|original recipe"),
    ("taco", r"\btaco\b|tostada|chalupa|gordita"),
    ("burrito", r"burrito|chimichanga|quesadilla|enchilada"),
    ("bowl", r"\bbowls?\b"),
    ("pizza", r"pizza|calzone|stromboli|flatbread"),
    ("wrap", r"\bwraps?\b|cool wrap"),
    ("sub-sandwich", r"\bsub\b|hoagie|footlong|\d+\s*(?:in\b|\")|b\.?m\.?t\.?|cheesesteak"),
    ("breakfast-sandwich", r"biscuit|mcmuffin|croissan|egg white grill|breakfast sandwich|english muffin|breakfast burrito"),
    ("sandwich", r"sandwich|panini|\bmelt\b|\bb\.?l\.?t\.?\b|\bclub\b|reuben"),
    ("salad", r"salad|\bgreens\b|slaw"),
    ("soup", r"soup|chili\b|bisque|chowder"),
    ("pasta", r"pasta|spaghetti|alfredo|lasagna|macaroni|mac & cheese|mac and cheese|fettuccine|ravioli|penne"),
    ("steak", r"steak|sirloin|ribeye|brisket|prime rib"),
    ("seafood", r"shrimp|salmon|\bfish\b|crab|lobster|tilapia|scallop|calamari"),
    ("ribs", r"\brib\b|ribs\b|riblet"),
    ("hot-dog", r"hot dog|corn dog|frank\b"),
    ("fries", r"\bfries\b|waffle potato|tater|potato wedge|onion ring|curly fries"),
    ("hash-browns", r"hash brown|hashbrown"),
    ("baked-potato", r"baked potato|mashed potato"),
    ("chips", r"chips|crisps|nacho"),
    ("side-vegetables", r"broccoli|\bcorn\b|green bean|\bbeans\b|carrot|vegetable|\brice\b|asparagus"),
    ("bread", r"bagel|\btoast\b|\bbread\b|\broll\b|pretzel|breadstick|biscuit only"),
    ("egg", r"\begg\b|omelet|scramble"),
    ("bacon", r"bacon|sausage|\bham\b"),
    ("cheese", r"\bcheese\b|queso"),
    ("sauce", r"sauce|dressing|\bdip\b|syrup|mayo|ketchup|mustard|vinaigrette|guacamole|salsa|sour cream"),
    ("cookie", r"cookie|brownie"),
    ("donut", r"donut|doughnut"),
    ("cake", r"cake|\bpie\b|cheesecake|cinnamon roll|danish|muffin|pastry|churro|cobbler"),
    ("yogurt", r"yogurt|parfait"),
    ("fruit", r"fruit|apple slice|banana|berries|grapes|orange\b|melon"),
)
# Archetypes of categories, and the default.
BY_CATEGORY = {"Beverages": "drink", "Toppings & Ingredients": "ingredients", "Entrees": "plated-meal", "Sandwiches": "sandwich", "Appetizers & Sides": "side-dish",
               "Pizza": "pizza", "Desserts": "dessert", "Baked Goods": "bread", "Salads": "salad", "Burgers": "hamburger", "Soup": "soup", "Fried Potatoes": "fries"}
DEFAULT = "plated-meal"
# The order of sections, and what makes a dish a breakfast.
SECTIONS = ("Breakfast", "Burgers", "Sandwiches", "Entrees", "Pizza", "Salads", "Soup", "Appetizers & Sides", "Fried Potatoes", "Baked Goods", "Desserts", "Beverages", "Toppings & Ingredients")
BREAKFAST_FROM = ("Sandwiches", "Entrees", "Baked Goods", "Appetizers & Sides", "Fried Potatoes")
BREAKFAST_NAMES = r"(?i)\b(breakfast|mc\s?muffins?|mc\s?griddles?|hot\s?cakes?|pancakes?|french toast|omelet(te)?s?|scrambled eggs?|hash\s?browns?|oatmeal|grits|benedict|frittata|sausage gravy|egg whites?)\b"
BREAKFAST_CARRIERS = r"(?i)\b(biscuits?|bagels?|croissants?|english muffins?|burritos?|platters?|muffins?)\b"
OTHER_CARRIERS = r"(?i)\b(sandwich(es)?|wraps?|bowls?|tacos?|flatbreads?|rolls?|toast)\b"
FILLINGS = r"(?i)\b(eggs?|sausages?|bacon|ham|steak|gravy)\b"
EGGS = r"(?i)\beggs?\b"
NO_BREAKFAST = r"(?i)\b(waffle (cone|bowl|fries|potato)|pretzel)\b"
# Ends of names that are additions or bottled drinks, and names that are nothing else.
ADDITION_ENDS = r"(?i)\b(?:sauce|dressing|spread|aioli|mayo|mayonnaise|mustard|ketchup|vinaigrette|syrup|jam|jelly|preserves|creamer|sweetener|splenda|stevia|seasoning|boost|booster|topping|toppings|sugar|butter|half\s*(?:&|and)\s*half)\s*$"
DRINK_ENDS = r"(?i)\b(?:beer|ale|ipa|lager|pilsner|stout|porter|cerveza|cider|seltzer|hefeweizen|draft|draught)\s*$"
PORTION_ENDS = r"(?i)(?:[\s\-–]+(?:cups?|packets?|portions?|sides?|containers?|tubs?|pats?|dipping|small|large|medium|kids?)\s*)+$"
ALONE = ("topping", "toppings", "add-on", "add on", "addon", "packet")
PLAIN_ADDITIONS = ("sugar", "honey", "butter", "salt", "pepper", "ice", "sweetener", "creamer", "sour cream", "salsa", "ranch")
MADE_IN_HOUSE = r"(?i)\b(?:float|freeze|freezee|slush|slushie|icee|shakes?|frappe|frosty|blizzard|sundae|cake|pie)\b"
PACKAGED = (r"(?i)\b(?:coca[- ]?cola|coke|pepsi|starry|sprite|fanta|crush|dr\.? pepper|pibb|mtn dew|mountain dew|sierra mist|mello yello|barq|7\s*up|mug root beer|schweppes|canada dry|"
            r"dasani|aquafina|smartwater|vitaminwater|perrier|san pellegrino|gatorade|powerade|body ?armor|red bull|celsius|amp energy|(?<!cookie )monster|"
            r"tropicana|minute maid|simply (?:orange|lemonade|apple)|dole|ocean spray|naked juice|izze|snapple|honest tea|gold peak|pure leaf|lipton|sobe|bubly|core power|hi-?c|nestea|"
            r"bai|essentia|life ?wtr|life ?water|propel|a&w|blue moon|angry orchard|modelo|corona|dos equis|michelob|bud light|budweiser|coors|miller lite|stella artois|heineken|pacifico|yuengling|"
            r"guinness|sam adams|samuel adams|lagunitas|sierra nevada|goose island|white claw|truly hard)\b")


def first_rule(text: Column, rules=ARCHETYPES) -> Column:
    """The first rule whose pattern is found in the text, or null."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        found = F.when(F.regexp_like(text, F.lit(pattern)), name).otherwise(found)
    return found


def archetype(name: Column, category: Column) -> Column:
    """By the name before 'for', then the whole name, then the category, then the default."""
    head = F.get(F.split(name, r",?\s+for\s+", 2), F.lit(0))
    by_category = F.lit(DEFAULT)
    for key, value in BY_CATEGORY.items():
        by_category = F.when(category == key, value).otherwise(by_category)
    return F.coalesce(first_rule(F.lower(head)), F.when(head != name, first_rule(F.lower(name))), by_category)


def is_breakfast(name: Column, category: Column) -> Column:
    has = lambda p: F.regexp_like(name, F.lit(p))
    kind = has(BREAKFAST_NAMES) | (has(BREAKFAST_CARRIERS) & has(FILLINGS)) | (has(OTHER_CARRIERS) & has(EGGS))
    return F.coalesce(category.isin(*BREAKFAST_FROM) & ~has(NO_BREAKFAST) & kind, F.lit(False))


def section(name: Column, category: Column) -> Column:
    return F.when(is_breakfast(name, category), "Breakfast").otherwise(category)


def section_order(name: Column) -> Column:
    """Places of the known sections; others come after them."""
    place = F.lit(len(SECTIONS))
    for i, known in enumerate(SECTIONS):
        place = F.when(name == known, i).otherwise(place)
    return place


def needs_own_photo(name: Column) -> Column:
    """Whether a dish is photographed itself: not additions, packets or bottled brands."""
    text = F.trim(F.regexp_replace(name, r"\s+", " "))
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)^\s*drive[\s-]*thru\s*,\s*", ""), r"^\s*\(?\d+\)?\s*", "")
    head = F.regexp_replace(F.get(F.split(bare, r"(?i),|\bfor\b|\bwith\b|\bw/|\(|\s-\s|\s–\s", 2), F.lit(0)), r"^[\s\-–]+|[\s\-–]+$", "")
    head = F.when(head == "", bare).otherwise(head)
    alone = F.exists(F.split(name, ","), lambda p: F.lower(F.trim(p)).isin(*ALONE)) | F.lower(text).isin(*PLAIN_ADDITIONS)
    short = F.regexp_replace(head, PORTION_ENDS, "")
    has = lambda t, p: F.regexp_like(t, F.lit(p))
    return F.when(alone, False).when(has(head, MADE_IN_HOUSE), True).when(has(head, PACKAGED), False).otherwise(~(has(short, ADDITION_ENDS) | has(short, DRINK_ENDS)))
