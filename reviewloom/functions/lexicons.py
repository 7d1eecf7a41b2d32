"""Word lists and rule texts of the opinion pipeline: fixed values, in the order in which ties are broken."""

STRONG = (
    "good bad great terrible excellent awful nice horrible wonderful poor amazing disappointing love hate like dislike perfect flawed "
    "fantastic awful brilliant mediocre outstanding pathetic satisfied disappointed pleased frustrated impressed unimpressed"
).split()
SUGGESTION = "should recommend suggest advice tip better prefer wish hope expect would could consider try avoid worth worthwhile".split()
COMPARISON = "better worse compared than versus vs similar different same instead rather prefer preferable superior inferior".split()
PROBLEM = ["problem", "issue", "defect", "flaw", "broken", "faulty", "malfunction", "error", "bug", "glitch", "failure", "failed", "doesn't work", "won't work", "stopped working", "not working"]
FUNCTION = "works functions performs operates runs handles manages supports provides delivers meets exceeds fails lacks missing".split()
EXPERIENCE = ["after", "since", "when", "used", "tried", "tested", "bought", "purchased", "owned", "have had", "been using", "for months", "for years", "so far", "up to now"]
NEGATION = "not never no none nothing nobody neither nor".split()
INTENSITY = "very extremely quite really too so pretty rather".split()

ASPECT_SEEDS = "battery screen size quality price design performance speed weight durability sound camera display storage memory processor build material comfort usability interface".split()
STOP_NOUNS = "product item thing it this that one review amazon seller company brand".split()
ADJECTIVES = (
    "good bad great excellent poor nice fine big small large tiny fast slow long short heavy light cheap expensive durable fragile strong weak "
    "clear bright dark loud quiet smooth rough soft hard comfortable uncomfortable"
).split()
PRONOUNS = "it this that they".split()
POSITIVE = "good great excellent amazing wonderful fantastic perfect love like enjoy satisfied happy pleased impressed outstanding superb brilliant awesome best better nice fine decent".split()
NEGATIVE = "bad terrible awful horrible worst hate disappointed disappointing poor cheap broken defective faulty useless waste regret return refund problem issue flaw defect damaged".split()
FLIPS = "not no never none neither nobody nothing nowhere without lack missing fail cannot".split()

ASPECT_SYNONYMS = {
    "shipping": "delivery",
    "delivery": "delivery",
    "shipping speed": "delivery",
    "delivery time": "delivery",
    "battery": "battery",
    "battery life": "battery",
    "battery performance": "battery",
    "screen": "display",
    "display": "screen",
    "screen quality": "display",
    "display quality": "display",
    "price": "price",
    "cost": "price",
    "pricing": "price",
    "quality": "quality",
    "build quality": "quality",
    "material quality": "quality",
    "performance": "performance",
    "speed": "performance",
    "performance speed": "performance",
    "design": "design",
    "appearance": "design",
    "look": "design",
    "size": "size",
    "dimension": "size",
    "dimensions": "size",
    "weight": "weight",
    "weight of product": "weight",
    "sound": "sound",
    "audio": "sound",
    "sound quality": "sound",
    "audio quality": "sound",
    "customer service": "customer service",
    "support": "customer service",
    "service": "customer service",
}
NOISE_TERMS = "product item thing it this that one stuff review comment feedback".split()
NOISE_ISSUES = ["good", "bad", "nice", "works", "not good", "not bad", "ok", "okay", "fine", "great", "terrible", "awful"]
