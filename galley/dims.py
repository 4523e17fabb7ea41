"""Unit tables, densities, portions, word lists and season tables, as they are defined."""

from __future__ import annotations

#: Grams of one unit.
UNIT_GRAMS = {'g': 1.0,
 'kg': 1000.0,
 'ml': 1.0,
 'l': 1000.0,
 'cl': 10.0,
 'dl': 100.0,
 'cup': 240.0,
 'tbsp': 15.0,
 'tsp': 5.0,
 'oz': 28.35,
 'lb': 453.6,
 'pinch': 0.5,
 'dash': 0.5,
 'cs': 15.0,
 'cc': 5.0}

#: Grams of one piece.
PIECE_GRAMS = {'egg': 50,
 'onion': 150,
 'garlic': 5,
 'tomato': 150,
 'potato': 200,
 'carrot': 80,
 'apple': 180,
 'lemon': 80,
 'lime': 60,
 'orange': 180,
 'banana': 120,
 'chicken thigh': 180,
 'chicken breast': 200,
 'chicken leg': 250,
 'chicken wing': 80,
 'bell pepper': 150,
 'red bell pepper': 150,
 'green bell pepper': 150,
 'yellow bell pepper': 150,
 'shallot': 30,
 'bay leaf': 1,
 'fresh thyme': 3,
 'zucchini': 200,
 'eggplant': 300,
 'cucumber': 300,
 'leek': 200,
 'celery': 60,
 'pear': 180,
 'peach': 150,
 'avocado': 170,
 'mushroom': 20,
 'button mushroom': 20,
 'cherry tomato': 15,
 'sweet potato': 200,
 'turnip': 150,
 'beetroot': 150,
 'endive': 120,
 'fennel': 250,
 'artichoke': 300,
 'cauliflower': 600,
 'broccoli': 400,
 'cabbage leaves': 30,
 'cabbage leaf': 30,
 'cabbage': 1000,
 'white cabbage': 1000,
 'red cabbage': 1000,
 'napa cabbage': 900,
 'savoy cabbage': 900,
 'romaine lettuce': 300,
 'iceberg lettuce': 500,
 'asparagus': 20,
 'fig': 50,
 'figs': 50,
 'plum': 70,
 'apricot': 40,
 'nectarine': 140,
 'mango': 200,
 'kiwi': 75,
 'pomegranate': 250,
 'grapefruit': 250,
 'clementine': 70,
 'date': 24,
 'dates': 24,
 'medjool date': 24,
 'medjool dates': 24,
 'prune': 10,
 'prunes': 10,
 'raisin': 1,
 'goat cheese': 60,
 'mozzarella': 125,
 'burrata': 150,
 'cream cheese': 30,
 'country bread': 60,
 'bread': 40,
 'baguette': 250,
 'pita': 60,
 'tortilla': 40,
 'bun': 60,
 'buns': 60,
 'brioche': 60,
 'croissant': 60,
 'puff pastry': 280,
 'filo pastry': 20,
 'phyllo dough': 20,
 'walnut': 30,
 'almond': 30,
 'hazelnut': 30,
 'pecan': 30,
 'cashew': 30,
 'pistachio': 30,
 'pine nut': 15,
 'arugula': 20,
 'spinach': 30,
 'lettuce': 50,
 'kale': 30,
 'watercress': 20,
 'basil leaves': 5,
 'mint leaves': 5,
 'cilantro': 5,
 'parsley': 10,
 'honey': 21,
 'maple syrup': 20,
 'olive oil': 14,
 'soy sauce': 15,
 'vinegar': 15,
 'mustard': 15,
 'tahini': 15,
 'butter': 15,
 'salted butter': 15,
 'bouillon cube': 10,
 'vegetable bouillon cube': 10,
 'chicken bouillon cube': 10,
 'beef bouillon cube': 10,
 'stock cube': 10,
 'yeast': 7,
 'dry yeast': 7,
 'active dry yeast': 7,
 'instant yeast': 7,
 'fresh yeast': 21,
 "baker's yeast": 7,
 'rice paper': 8,
 'wonton wrapper': 8,
 'spring roll wrapper': 8,
 'nori': 3,
 'nori sheet': 3,
 'pearl onion': 12,
 'pearl onions': 12,
 'cipollini onion': 30,
 'cipollini': 30,
 'cocktail onion': 8,
 'butternut squash': 900,
 'cinnamon stick': 3,
 'cinnamon sticks': 3}

#: Grams of a spoon or cup by name.
PORTION_GRAMS = {'olive oil': {'tbsp': 13.5, 'tsp': 4.5, 'cup': 216.0},
 'extra-virgin olive oil': {'tbsp': 13.5, 'tsp': 4.5, 'cup': 216.0},
 'extra virgin olive oil': {'tbsp': 13.5, 'tsp': 4.5, 'cup': 216.0},
 'vegetable oil': {'tbsp': 13.5, 'tsp': 4.5, 'cup': 218.0},
 'canola oil': {'tbsp': 14.0, 'tsp': 4.7, 'cup': 224.0},
 'coconut oil': {'tbsp': 13.6, 'tsp': 4.5, 'cup': 218.0},
 'sesame oil': {'tbsp': 13.6, 'tsp': 4.5, 'cup': 218.0},
 'avocado oil': {'tbsp': 14.0, 'tsp': 4.7},
 'lemon juice': {'tbsp': 15.2, 'tsp': 5.1, 'cup': 244.0},
 'fresh lemon juice': {'tbsp': 15.2, 'tsp': 5.1, 'cup': 244.0},
 'lime juice': {'tbsp': 15.4, 'tsp': 5.1, 'cup': 246.0},
 'fresh lime juice': {'tbsp': 15.4, 'tsp': 5.1, 'cup': 246.0},
 'orange juice': {'tbsp': 15.6, 'tsp': 5.2, 'cup': 248.0},
 'honey': {'tbsp': 21.0, 'tsp': 7.0, 'cup': 339.0},
 'sugar': {'tbsp': 12.5, 'tsp': 4.2, 'cup': 200.0},
 'granulated sugar': {'tbsp': 12.5, 'tsp': 4.2, 'cup': 200.0},
 'brown sugar': {'tbsp': 13.8, 'tsp': 4.6, 'cup': 220.0},
 'powdered sugar': {'tbsp': 8.0, 'tsp': 2.7, 'cup': 120.0},
 'maple syrup': {'tbsp': 20.0, 'tsp': 6.7, 'cup': 322.0},
 'soy sauce': {'tbsp': 16.0, 'tsp': 5.3},
 'fish sauce': {'tbsp': 18.0, 'tsp': 6.0},
 'tomato paste': {'tbsp': 16.3, 'tsp': 5.4},
 'dijon mustard': {'tbsp': 15.0, 'tsp': 5.0},
 'whole grain mustard': {'tbsp': 15.0, 'tsp': 5.0},
 'lemon zest': {'tbsp': 6.0, 'tsp': 2.0},
 'orange zest': {'tbsp': 6.0, 'tsp': 2.0},
 'lime zest': {'tbsp': 6.0, 'tsp': 2.0},
 'chilli flakes': {'tbsp': 5.4, 'tsp': 1.8},
 'red pepper flakes': {'tbsp': 5.4, 'tsp': 1.8},
 'balsamic vinegar': {'tbsp': 16.0, 'tsp': 5.3},
 'rice vinegar': {'tbsp': 15.0, 'tsp': 5.0},
 'apple cider vinegar': {'tbsp': 15.0, 'tsp': 5.0},
 'worcestershire sauce': {'tbsp': 17.0, 'tsp': 5.7},
 'hot sauce': {'tbsp': 15.0, 'tsp': 5.0},
 'sriracha': {'tbsp': 17.0, 'tsp': 5.7},
 'miso paste': {'tbsp': 17.0, 'tsp': 5.7},
 'tahini': {'tbsp': 15.0, 'tsp': 5.0},
 'peanut butter': {'tbsp': 16.0, 'tsp': 5.3},
 'almond butter': {'tbsp': 16.0, 'tsp': 5.3},
 'vanilla extract': {'tbsp': 13.0, 'tsp': 4.2},
 'cornstarch': {'tbsp': 8.0, 'tsp': 2.7, 'cup': 128.0},
 'cocoa powder': {'tbsp': 5.4, 'tsp': 1.8, 'cup': 86.0},
 'baking powder': {'tbsp': 13.8, 'tsp': 4.6},
 'baking soda': {'tbsp': 13.8, 'tsp': 4.6}}

#: Grams of a millilitre by name part.
DENSITIES = {'olive oil': 0.92,
 'vegetable oil': 0.92,
 'canola oil': 0.92,
 'rapeseed oil': 0.92,
 'sunflower oil': 0.92,
 'peanut oil': 0.92,
 'corn oil': 0.92,
 'soybean oil': 0.93,
 'coconut oil': 0.92,
 'sesame oil': 0.92,
 'avocado oil': 0.92,
 'grapeseed oil': 0.92,
 'walnut oil': 0.92,
 'hazelnut oil': 0.92,
 'truffle oil': 0.92,
 'neutral oil': 0.92,
 'frying oil': 0.92,
 'oil': 0.92,
 'lard': 0.92,
 'duck fat': 0.92,
 'goose fat': 0.92,
 'bacon fat': 0.92,
 'rendered fat': 0.92,
 'ghee': 0.92,
 'clarified butter': 0.92,
 'whole milk': 1.03,
 'milk': 1.03,
 'skim milk': 1.04,
 'buttermilk': 1.02,
 'evaporated milk': 1.07,
 'coconut milk': 1.01,
 'oat milk': 1.03,
 'almond milk': 1.02,
 'soy milk': 1.03,
 'heavy cream': 0.99,
 'whipping cream': 0.96,
 'double cream': 0.94,
 'light cream': 1.01,
 'single cream': 1.0,
 'cream': 1.0,
 'creme fraiche': 1.0,
 'sour cream': 1.0,
 'yogurt': 1.04,
 'yoghurt': 1.04,
 'honey': 1.42,
 'maple syrup': 1.32,
 'corn syrup': 1.38,
 'agave syrup': 1.36,
 'agave nectar': 1.36,
 'golden syrup': 1.38,
 'treacle': 1.38,
 'molasses': 1.42,
 'grenadine': 1.18,
 'simple syrup': 1.26,
 'syrup': 1.32,
 'red wine': 0.99,
 'white wine': 0.99,
 'wine': 0.99,
 'beer': 1.01,
 'cider': 1.01,
 'cognac': 0.95,
 'brandy': 0.95,
 'rum': 0.95,
 'vodka': 0.95,
 'whiskey': 0.94,
 'whisky': 0.94,
 'gin': 0.95,
 'tequila': 0.95,
 'marsala': 1.01,
 'port': 1.03,
 'sherry': 1.0,
 'vermouth': 1.03,
 'amaretto': 1.08,
 'kahlua': 1.13,
 'cointreau': 1.04,
 'grand marnier': 1.04,
 'limoncello': 1.05,
 'mirin': 1.08,
 'sake': 1.0,
 'rice wine': 1.0,
 'vinegar': 1.01,
 'balsamic vinegar': 1.05,
 'apple cider vinegar': 1.01,
 'red wine vinegar': 1.01,
 'white wine vinegar': 1.01,
 'rice vinegar': 1.01,
 'sherry vinegar': 1.01,
 'soy sauce': 1.12,
 'fish sauce': 1.1,
 'oyster sauce': 1.2,
 'worcestershire sauce': 1.13,
 'hot sauce': 1.05,
 'sriracha': 1.1,
 'tabasco': 1.05,
 'tomato paste': 1.1,
 'tomato sauce': 1.03,
 'ketchup': 1.15,
 'mayonnaise': 0.91,
 'mustard': 1.05,
 'tahini': 1.08,
 'lemon juice': 1.04,
 'lime juice': 1.04,
 'orange juice': 1.04,
 'apple juice': 1.04,
 'grape juice': 1.05,
 'pomegranate juice': 1.05,
 'cranberry juice': 1.05,
 'juice': 1.04,
 'broth': 1.01,
 'stock': 1.01,
 'bouillon': 1.01,
 'coconut cream': 1.02,
 'condensed milk': 1.28}

#: Spellings of units.
UNIT_ALIASES = {'tablespoon': 'tbsp',
 'tablespoons': 'tbsp',
 'teaspoon': 'tsp',
 'teaspoons': 'tsp',
 'dessertspoon': 'tsp',
 'dessertspoons': 'tsp',
 'cup': 'cup',
 'cups': 'cup',
 'liter': 'l',
 'litre': 'l',
 'liters': 'l',
 'litres': 'l',
 'gram': 'g',
 'grams': 'g',
 'kilogram': 'kg',
 'kilograms': 'kg',
 'ounce': 'oz',
 'ounces': 'oz',
 'pound': 'lb',
 'pounds': 'lb',
 'clove': 'clove',
 'cloves': 'clove',
 'sprig': 'sprig',
 'sprigs': 'sprig',
 'slice': 'slice',
 'slices': 'slice',
 'piece': 'piece',
 'pieces': 'piece',
 'bunch': 'bunch',
 'bunches': 'bunch',
 'leaf': 'leaf',
 'leaves': 'leaf',
 'stalk': 'stalk',
 'stalks': 'stalk',
 'head': 'head',
 'heads': 'head',
 'bulb': 'bulb',
 'bulbs': 'bulb',
 'spear': 'spear',
 'spears': 'spear',
 'sheet': 'sheet',
 'sheets': 'sheet',
 'strip': 'strip',
 'strips': 'strip',
 'fillet': 'fillet',
 'filet': 'fillet',
 'fillets': 'fillet',
 'filets': 'fillet',
 'can': 'can',
 'cans': 'can',
 'jar': 'jar',
 'jars': 'jar',
 'packet': 'packet',
 'packets': 'packet',
 'package': 'packet',
 'packages': 'packet',
 'stick': 'stick',
 'sticks': 'stick',
 'knob': 'knob',
 'knobs': 'knob',
 'handful': 'handful',
 'handfuls': 'handful',
 'drop': 'drop',
 'drops': 'drop',
 'square': 'square',
 'squares': 'square',
 'cube': 'cube',
 'cubes': 'cube',
 'gousse': 'clove',
 'gousses': 'clove',
 'poignée': 'handful',
 'poignee': 'handful',
 'botte': 'bunch',
 'bottes': 'bunch',
 'brin': 'sprig',
 'brins': 'sprig',
 'branche': 'sprig',
 'branches': 'sprig',
 'sachet': 'packet',
 'sachets': 'packet',
 'rouleau': 'sheet',
 'rouleaux': 'sheet',
 'tranche': 'slice',
 'tranches': 'slice',
 'morceau': 'piece',
 'morceaux': 'piece',
 'pincée': 'pinch',
 'pincee': 'pinch',
 'trait': 'dash',
 'tige': 'stalk',
 'tiges': 'stalk',
 'feuille': 'leaf',
 'feuilles': 'leaf',
 'barquette': 'packet',
 'barquettes': 'packet'}

#: Words before a unit that do not count.
UNIT_ADJECTIVES = ['small', 'large', 'big', 'medium', 'heaped', 'heaping', 'rounded', 'level', 'generous', 'good', 'thick', 'thin', 'whole', 'fresh', 'scant', 'packed',
 'loosely', 'tightly', 'firmly', 'lightly']

#: Units that count pieces.
PIECE_LIKE_UNITS = ['piece', 'slice', 'bunch', 'sprig', 'clove', 'leaf', 'stalk', 'head', 'bulb', 'spear', 'sheet', 'strip', 'fillet', 'stick', 'square']

#: Grams of a unit for names without their own weight.
DEFAULT_UNIT_GRAMS = {'handful': 30.0,
 'knob': 15.0,
 'drop': 0.05,
 'leaf': 2.0,
 'sprig': 3.0,
 'stalk': 40.0,
 'head': 300.0,
 'bulb': 250.0,
 'spear': 20.0,
 'sheet': 15.0,
 'square': 5.0,
 'cube': 10.0,
 'stick': 15.0}

#: Units that stand alone before a description.
MASS_AND_VOLUME_UNITS = ['g', 'kg', 'ml', 'l', 'cl', 'dl', 'oz', 'lb']

#: Name parts.
ALCOHOL = ['wine', 'white wine', 'red wine', 'beer', 'cognac', 'brandy', 'marsala', 'rum', 'port', 'sherry', 'vermouth']

#: Name parts.
DISCARDED = ['pasta water', 'blanching water', 'cooking water']

#: Title parts.
SOUPS = ['soupe', 'soup', 'velouté', 'veloute', 'potage', 'bisque', 'minestrone', 'bouillon', 'consommé', 'consomme', 'chowder', 'gazpacho', 'harira',
 'chorba']

#: Name parts.
FRYING_OILS = ['peanut oil', 'vegetable oil', 'canola oil', 'sunflower oil', 'corn oil', 'soybean oil', 'frying oil', 'neutral oil']

#: Name parts.
CONFIT_FATS = ['duck fat', 'goose fat', 'lard', 'schmaltz', 'tallow', 'rendered fat', 'bacon fat', 'beef dripping']

#: Share of a cooking liquid that is eaten.
RETENTION = {'discard': 0.0, 'alcohol': 0.2, 'soup_broth': 0.8, 'braising': 0.3, 'frying_oil': 0.15, 'confit_fat': 0.2}

#: Quantity and unit of names listed without one.
DEFAULT_QUANTITIES = {'olive oil': (1, 'tbsp'),
 'extra-virgin olive oil': (1, 'tbsp'),
 'extra virgin olive oil': (1, 'tbsp'),
 'oil': (1, 'tbsp'),
 'vegetable oil': (1, 'tbsp'),
 'sunflower oil': (1, 'tbsp'),
 'canola oil': (1, 'tbsp'),
 'rapeseed oil': (1, 'tbsp'),
 'coconut oil': (1, 'tbsp'),
 'sesame oil': (1, 'tsp'),
 'truffle oil': (1, 'tsp'),
 'neutral oil': (1, 'tbsp'),
 'frying oil': (2, 'tbsp'),
 'butter': (1, 'tbsp'),
 'unsalted butter': (1, 'tbsp'),
 'salted butter': (1, 'tbsp'),
 'ghee': (1, 'tbsp'),
 'honey': (1, 'tbsp'),
 'maple syrup': (1, 'tbsp'),
 'agave syrup': (1, 'tbsp'),
 'sugar': (1, 'tsp'),
 'powdered sugar': (1, 'tbsp'),
 'brown sugar': (1, 'tsp'),
 'balsamic vinegar': (1, 'tbsp'),
 'soy sauce': (1, 'tbsp'),
 'fish sauce': (1, 'tsp'),
 'sriracha': (1, 'tsp'),
 'hot sauce': (1, 'tsp'),
 'cream': (2, 'tbsp'),
 'heavy cream': (2, 'tbsp'),
 'sour cream': (1, 'tbsp'),
 'feta cheese': (30, 'g'),
 'parmesan': (10, 'g'),
 'parmesan cheese': (10, 'g')}

#: Names without weight in a profile.
NEGLIGIBLE = ['salt', 'table salt', 'sea salt', 'fleur de sel', 'coarse salt', 'kosher salt', 'flaky salt', 'himalayan salt', 'smoked salt', 'black pepper',
 'white pepper', 'pepper', 'peppercorns', 'ground pepper', 'cracked pepper', 'szechuan pepper', 'water', 'ice', 'ice water', 'cold water',
 'hot water', 'mineral water', 'sparkling water', 'boiling water', 'baking soda', 'baking powder', 'cinnamon', 'ground cinnamon', 'nutmeg',
 'ground nutmeg', 'paprika', 'smoked paprika', 'sweet paprika', 'cumin', 'ground cumin', 'cumin seeds', 'turmeric', 'ground turmeric',
 'cayenne pepper', 'cayenne', 'chili powder', 'chili flakes', 'red pepper flakes', 'crushed red pepper', 'curry powder', 'garam masala', 'baharat',
 'cloves', 'ground cloves', 'allspice', 'ground allspice', 'cardamom', 'ground cardamom', 'cardamom pods', 'coriander seeds', 'ground coriander',
 'saffron', 'saffron threads', 'star anise', 'anise seeds', 'fennel seeds', 'ras el hanout', 'espelette pepper', 'hot pepper', "za'atar", 'sumac',
 'fenugreek', 'mustard seeds', 'caraway seeds', 'celery seeds', 'juniper berries', 'mace', 'grains of paradise', 'msg', 'monosodium glutamate',
 'sea salt flakes', 'fleur de sel flakes', 'maldon salt', 'nigella seeds', 'red deadnettle', 'deadnettle', 'cleavers', 'dried pansies',
 'dried flowers', 'edible flowers', 'food coloring', 'vanilla extract', 'vanilla paste', 'vanilla bean', 'vanilla sugar', 'cooking spray',
 'nonstick spray', 'parchment paper', 'wax paper', 'aluminum foil', 'plastic wrap', 'cling film', 'cheesecloth', 'muslin cloth', 'toothpicks',
 'toothpick', 'skewers', 'skewer', 'bamboo skewers', 'wooden skewers', 'cocktail picks', 'kitchen twine', "butcher's twine", 'kitchen string',
 'paper towels', 'paper towel', 'cupcake liners', 'muffin liners', 'popsicle sticks', 'ice cream sticks', 'piping bag', 'pastry bag']

#: Herbs.
HERBS = ['basil', 'basil leaves', 'fresh basil', 'parsley', 'fresh parsley', 'flat-leaf parsley', 'cilantro', 'fresh cilantro', 'coriander leaves', 'oregano',
 'fresh oregano', 'thyme', 'fresh thyme', 'fresh thyme sprigs', 'rosemary', 'fresh rosemary', 'chives', 'fresh chives', 'dill', 'fresh dill', 'mint',
 'fresh mint', 'peppermint', 'tarragon', 'fresh tarragon', 'bay leaf', 'fresh bay leaf', 'bay leaves', 'sage', 'fresh sage', 'marjoram',
 'fresh marjoram']

#: Units in which herbs have no weight.
SMALL_HERB_UNITS = ['sprig', 'sprigs', 'leaf', 'leaves', 'pinch', 'dash', 'tsp', 'teaspoon', 'piece', 'bunch', 'handful', 'stalk']

#: Terms by diet list, in the order in which lists are tried.
DIET_TERMS = {'meat': ['chicken', 'beef', 'pork', 'lamb', 'veal', 'duck', 'turkey', 'goose', 'rabbit', 'venison', 'bison', 'quail', 'pheasant', 'ostrich', 'bacon',
          'ham', 'prosciutto', 'pancetta', 'sausage', 'chorizo', 'salami', 'pepperoni', 'mortadella', 'bresaola', 'coppa', 'ground beef',
          'ground pork', 'ground turkey', 'ground lamb', 'steak', 'roast beef', 'pork chop', 'lamb chop', 'rack of lamb', 'chicken breast',
          'chicken thigh', 'chicken leg', 'chicken wing', 'chicken drumstick', 'chicken liver', 'duck breast', 'duck leg', 'foie gras', 'pâté',
          'rillettes', 'confit', 'beef broth', 'chicken broth', 'bone broth', 'beef stock', 'chicken stock', 'lardons', 'guanciale', 'speck', 'lard',
          'manteca', 'chicharrón', 'suet', 'tallow', 'schmaltz'],
 'seafood': ['salmon', 'tuna', 'cod', 'halibut', 'sea bass', 'trout', 'mackerel', 'sardine', 'sardines', 'anchovy', 'anchovies', 'herring',
             'swordfish', 'tilapia', 'catfish', 'snapper', 'grouper', 'mahi mahi', 'sole', 'haddock', 'pollock', 'monkfish', 'skate', 'pike', 'perch',
             'carp', 'shrimp', 'prawn', 'prawns', 'crab', 'lobster', 'crayfish', 'langoustine', 'mussel', 'mussels', 'clam', 'clams', 'oyster',
             'oysters', 'scallop', 'scallops', 'squid', 'calamari', 'octopus', 'fish sauce', 'oyster sauce', 'fish stock', 'smoked salmon', 'gravlax',
             'lox', 'surimi', 'shrimp paste', 'belacan', 'bagoong', 'fermented shrimp', 'dried shrimp', 'bonito flakes', 'katsuobushi', 'dashi',
             'kimchi', 'nuoc mam', 'nam pla'],
 'dairy': ['milk', 'whole milk', 'skim milk', 'buttermilk', 'cream', 'heavy cream', 'whipping cream', 'light cream', 'half and half', 'sour cream',
           'crème fraîche', 'clotted cream', 'butter', 'salted butter', 'unsalted butter', 'clarified butter', 'cheese', 'cheddar', 'parmesan',
           'parmigiano reggiano', 'mozzarella', 'gruyère', 'gruyere', 'emmental', 'gouda', 'brie', 'camembert', 'blue cheese', 'roquefort',
           'gorgonzola', 'stilton', 'feta', 'goat cheese', 'ricotta', 'mascarpone', 'cream cheese', 'cottage cheese', 'halloumi', 'paneer', 'burrata',
           'pecorino', 'manchego', 'comté', 'raclette', 'reblochon', 'fontina', 'provolone', 'yogurt', 'greek yogurt', 'kefir', 'labneh', 'whey',
           'whey protein', 'casein', 'ghee', 'condensed milk', 'evaporated milk'],
 'egg': ['egg', 'eggs', 'egg white', 'egg whites', 'egg yolk', 'egg yolks', 'meringue', 'mayonnaise'],
 'non_vegan_other': ['honey', 'beeswax', 'royal jelly', 'propolis', 'gelatin', 'gelatine', 'isinglass', 'carmine', 'cochineal', 'lanolin', 'shellac',
                     'worcestershire sauce', 'caesar dressing', 'marshmallow', 'pesto', 'basil pesto']}

#: Peak months.
PRODUCE = {'vegetables': {'Artichoke': ['May', 'June', 'July', 'August', 'September'],
                'Asparagus': ['April', 'May', 'June'],
                'Beet': ['January', 'February', 'March', 'October', 'November', 'December'],
                'Beetroot': ['January', 'February', 'March', 'October', 'November', 'December'],
                'Bell Pepper': ['June', 'July', 'August', 'September'],
                'Broccoli': ['September', 'October', 'November'],
                'Brussels Sprout': ['January', 'February', 'March', 'October', 'November', 'December'],
                'Butternut': ['January', 'September', 'October', 'November', 'December'],
                'Cabbage': ['January', 'February', 'March', 'October', 'November', 'December'],
                'Carrot': ['January', 'February', 'March', 'September', 'October', 'November', 'December'],
                'Cauliflower': ['January', 'February', 'March', 'September', 'October', 'November', 'December'],
                'Celery': ['January', 'February', 'March', 'October', 'November', 'December'],
                'Chard': ['June', 'July', 'August', 'September', 'October', 'November'],
                'Corn': ['July', 'August', 'September'],
                'Corn Salad': ['January', 'February', 'October', 'November', 'December'],
                'Courgette': ['May', 'June', 'July', 'August', 'September', 'October'],
                'Cucumber': ['May', 'June', 'July', 'August', 'September', 'October'],
                'Eggplant': ['June', 'July', 'August', 'September'],
                'Endive': ['January', 'February', 'March', 'April', 'May', 'October'],
                'Fennel': ['April', 'June', 'July', 'August', 'September', 'October', 'November'],
                'Garlic': ['July', 'August', 'September', 'October', 'November', 'December'],
                'Green Bean': ['June', 'July', 'August', 'September', 'October'],
                'Jerusalem Artichoke': ['January', 'February', 'November', 'December'],
                "Lamb's Lettuce": ['January', 'February', 'October', 'November', 'December'],
                'Leek': ['January', 'February', 'March', 'April', 'September', 'October', 'November', 'December'],
                'Lettuce': ['May', 'June', 'July', 'August', 'September'],
                'Mache': ['January', 'February', 'October', 'November', 'December'],
                'Mushroom': ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November',
                             'December'],
                'Onion': ['January', 'February', 'March', 'April', 'September', 'October', 'November', 'December'],
                'Parsnip': ['January', 'February', 'March', 'October', 'November', 'December'],
                'Pea': ['May', 'June', 'July'],
                'Pepper': ['June', 'July', 'August', 'September'],
                'Pumpkin': ['January', 'September', 'October', 'November', 'December'],
                'Radish': ['March', 'April', 'May', 'June'],
                'Rutabaga': ['January', 'February', 'March', 'April', 'May', 'October', 'November', 'December'],
                'Salsify': ['January', 'February', 'March', 'November', 'December'],
                'Shallot': ['October', 'November', 'December'],
                'Spinach': ['January', 'February', 'March', 'April', 'May', 'September', 'October', 'November', 'December'],
                'Squash': ['January', 'September', 'October', 'November', 'December'],
                'Sweet Potato': ['September', 'October', 'November', 'December'],
                'Tomato': ['June', 'July', 'August', 'September'],
                'Turnip': ['January', 'February', 'March', 'April', 'May', 'October', 'November', 'December'],
                'Watercress': ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November',
                               'December'],
                'Zucchini': ['May', 'June', 'July', 'August', 'September', 'October'],
                'Porcini': ['June', 'July', 'August', 'September', 'October', 'November'],
                'Chanterelle': ['June', 'July', 'August', 'September', 'October'],
                'Morel': ['March', 'April', 'May', 'June'],
                'Trumpet Mushroom': ['September', 'October', 'November', 'December', 'January', 'February'],
                'Oyster Mushroom': ['September', 'October', 'November', 'December', 'January', 'February'],
                'Basil': ['June', 'July', 'August', 'September'],
                'Cilantro': ['May', 'June', 'July', 'August', 'September'],
                'Chive': ['May', 'June', 'July', 'August', 'September'],
                'Tarragon': ['June', 'July', 'August', 'September'],
                'Sorrel': ['April', 'May', 'June', 'July'],
                'Wild Garlic': ['March', 'April', 'May'],
                'Broad Bean': ['May', 'June', 'July'],
                'Kohlrabi': ['May', 'June', 'July', 'August', 'September', 'October'],
                'Celeriac': ['October', 'November', 'December', 'January', 'February', 'March'],
                'Black Radish': ['October', 'November', 'December', 'January', 'February'],
                'Swiss Chard': ['June', 'July', 'August', 'September', 'October', 'November'],
                'Okra': ['July', 'August', 'September']},
 'fruits': {'Apple': ['January', 'February', 'March', 'April', 'August', 'September', 'October', 'November', 'December'],
            'Apricot': ['June', 'July', 'August'],
            'Avocado': ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'],
            'Banana': ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'],
            'Blackberry': ['August', 'September'],
            'Blackcurrant': ['June', 'July', 'August'],
            'Blueberry': ['July', 'August', 'September'],
            'Cherry': ['June', 'July'],
            'Chestnut': ['October', 'November'],
            'Clementine': ['January', 'February', 'November', 'December'],
            'Coconut': ['January', 'February', 'November', 'December'],
            'Date': ['January', 'October', 'November', 'December'],
            'Fig': ['July', 'August', 'September', 'October'],
            'Grape': ['September', 'October'],
            'Grapefruit': ['February', 'March', 'April', 'May', 'June'],
            'Greengage': ['September'],
            'Hazelnut': ['September', 'October', 'November'],
            'Kiwi': ['January', 'February', 'March', 'November', 'December'],
            'Lemon': ['January', 'February'],
            'Mandarin': ['January', 'February', 'November', 'December'],
            'Melon': ['June', 'July', 'August', 'September'],
            'Nectarine': ['August', 'September'],
            'Orange': ['January', 'February', 'March'],
            'Passion Fruit': ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November',
                              'December'],
            'Peach': ['June', 'July', 'August', 'September'],
            'Pear': ['January', 'February', 'March', 'August', 'September', 'October', 'November', 'December'],
            'Persimmon': ['January', 'October', 'November', 'December'],
            'Pineapple': ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'],
            'Plum': ['July', 'August', 'September'],
            'Pomegranate': ['January', 'February', 'November', 'December'],
            'Quince': ['October'],
            'Raspberry': ['June', 'July', 'August'],
            'Redcurrant': ['June', 'July', 'August'],
            'Rhubarb': ['April', 'May', 'June'],
            'Star Fruit': ['January', 'November', 'December'],
            'Strawberry': ['May', 'June', 'July'],
            'Walnut': ['September', 'October'],
            'Watermelon': ['June', 'July', 'August', 'September']}}

#: Names without a season.
STAPLES = ['lemon', 'lime', 'orange', 'garlic', 'onion', 'potato', 'ginger', 'shallot', 'sweet potato', 'carrot', 'celery', 'mushroom', 'banana', 'hazelnut',
 'walnut', 'date', 'coconut']
