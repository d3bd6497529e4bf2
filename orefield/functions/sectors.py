"""Sector of a tender from its title and categories: an ordered cascade in one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that settle the sector on their own, in order.
DISTINCTIVE = [
    ("other", r"\badverti[sz]\w* rights\b|\bsale of (scrap|condemned)\b|\bdisposal of scrap\b|\brenting out\b|\blicen[cs]e to operate\b|\ballotment of (space|shops?)\b"),
    ("security", r"\bsecurity (services?|guards?|personnel|agency|staff)\b|\bcctv\b|\bsurveillance\b|\bfire (alarm|fighting|safety|extinguish\w*|detection|hydrant|suppression)\b|\baccess control\b|\bmetal detectors?\b|\bbaggage scanners?\b|\bbollards?\b"),
    ("it", r"\bsoftware\b|\bcomputers?\b|\blaptops?\b|\bdesktops?\b|\bservers?\b|\bnetworking\b|\b(computer|it|lan|wan|campus|wireless|data) networks?\b|\bnetwork (switch(es)?|equipment|infrastructure|cabling|devices|security|upgrade)\b|\bwebsite\b|\bdata cent(er|re)\b|\bcyber\b|\bict\b|\berp\b|\bwi-?fi\b|\boptical fib(er|re)\b|\bofc\b|\bit (services|infrastructure|equipment|hardware)\b|\bprinters?\b"),
]
#: Product categories that settle the sector before the title's other words, and those that do after them.
SPECIFIC = {
    "roads": "Civil Works - Highways|Civil Works - Roads|Civil Works - Bridges",
    "buildings": "Civil Works - Buildings",
    "water": "Civil Works - Water Works|Pipes and Pipe related activities|Pipe Laying Works|Water Supply/Equipments/Meter/Drilling/Boring|Drilling Works|Solid Waste Management",
    "electrical": "Electrical Works|Power/Energy Projects/Products|Electrical Goods/Equipment|Electrical Goods/Equipments|Street Lighting|Solar Street Lights|Air-Conditioner",
    "it": "Computer- H/W|Computer- S/W|Computer- Data Processing|Info. Tech. Services|Information Technology|OFC Laying Works|Electronics Equipment",
    "security": "Surveillance Equipments|Fire & Safety",
    "health": "Equipments (Hospital / Lab)|Medical Equipments/Waste|Consumables (Hospital / Lab)|Non Consumables (Hospital / Lab)|Drugs and Pharmaceutical Products",
    "lab": "Laboratory and scientific equipment",
    "facility": "Manpower Supply|Facility Management Services|Hotel/ Catering",
    "transport": "Hiring of Vehicles|Vehicles/Vehicle Spares|Shipping/ Transportation/ Vehicle|Aviation",
    "consultancy": "Consultancy|Survey",
    "supplies": "Stationery|Furniture/ Fixture|Sports Goods/Equipments",
}
GENERIC = {
    "buildings": "Civil Works|Civil Works - Others|Construction Works|Miscellaneous Works|Civil Construction Goods|Paint / Enamel Works",
    "water": "Marine Works",
    "supplies": "Miscellaneous Goods|Machineries/ Mechanical Engg Items|Mechanical Tools and Equipment|Machinery and Machining Tools|Electronic Components And Devices|Consumables- Raw materials|Food Products|Metal Fabrication",
}
#: The title's other words, in order.
KEYWORDS = [
    ("facility", r"\bhousekeeping\b|\bmanpower\b|\bcleaning\b|\bsweeping\b|\bscavenging\b|\boutsourc\w*\b|\bcatering\b|\bcanteen\b|\blaundry\b|\bhorticultur\w*\b|\bgardening\b|\bpest control\b|\bfacility management\b|\blawns?\b"),
    ("roads", r"\broads?\b|\bhighways?\b|\bnh-?\s?\d+|\bbridges?\b|\bflyovers?\b|\bculverts?\b|\bpavements?\b|\bcarriageway\b|\bbituminous\b|\bblack ?topping\b|\bexpressway\b|\bfoot ?(path|over bridge)\b|\brob\b|\b(two|four|six|eight|[2468])[- ]?lan(e|es|ing)\b|\bpaved shoulders?\b"),
    ("water", r"\bwater supply\b|\bpipe ?lines?\b|\bsewer(age)?\b|\bsewage\b|\bdrain(age|s)?\b|\bsanitation\b|\bstp\b|\b(bore|tube) ?wells?\b|\bwater ?(body|bodies|tank|treatment|works)\b|\bpumps?\b|\bplumbing\b|\bcanals?\b|\birrigation\b|\bdesilting\b|\bwaterbod(y|ies)\b"),
    ("electrical", r"\belectric(al|ity)?\b|\bpower (plant|supply|station)\b|\bsub-?stations?\b|\btransformers?\b|\bsolar\b|\blighting\b|\bstreet lights?\b|\bcables?\b|\bwiring\b|\bd\.?g\.? sets?\b|\bgenerators?\b|\b\d+\s?kva\b|\b\d+\s?kwp?\b|\bair.?condition\w*\b|\bhvac\b|\blifts?\b|\belevators?\b|\be&m\b|\bhigh voltage\b|\brelays?\b"),
    ("health", r"\bmedic(al|ine|ines)\b|\bdrugs?\b|\bsurgical\b|\bpharma\w*\b|\bdiagnostic\b|\bpatients?\b|\bambulances?\b|\bx-?ray\b|\bmri\b|\bventilators?\b|\bdental\b|\bvaccines?\b|\bhospital (equipment|consumables|supplies)\b|\bmgps\b|\bmedical gas\b"),
    ("lab", r"\blaborator(y|ies)\b|\blab\b|\bscientific\b|\bmicroscopes?\b|\bspectro\w*\b|\bchromatograph\w*\b|\breagents?\b|\bchemicals?\b|\banaly[sz]ers?\b"),
    ("transport", r"\bvehicles?\b|\btaxis?\b|\bbuses\b|\btransportation\b|\blogistics\b|\btrucks?\b|\bhiring of (cars?|jeeps?)\b"),
    ("consultancy", r"\bconsultan(cy|ts?)\b|\bdpr\b|\bdetailed project report\b|\bfeasibility\b|\bsurvey\b|\bstudy\b|\baudit\b|\bproject management\b|\bpmc\b|\barchitect\w*\b"),
    ("buildings", r"\bbuildings?\b|\bconstruction\b|\brenovation\b|\brepairs?\b|\bquarters?\b|\bqtrs?\b|\bflooring\b|\bpainting\b|\bwhite ?washing\b|\bdistemper\w*\b|\btoilets?\b|\bboundary wall\b|\broof\w*\b|\bplaster\w*\b|\bcivil\b|\bm/o\b|\bhostels?\b|\bconservation\b|\bmonuments?\b"),
]
FALLBACK = {"Works": "buildings", "Goods": "supplies"}


def classify(title: Column, product_category: Column, category: Column) -> Column:
    """Distinctive words, specific category, keywords, generic category, main category, then 'other'."""
    text, product = F.coalesce(title, F.lit("")), F.coalesce(product_category, F.lit(""))
    steps = [(text.rlike(f"(?i){p}"), s) for s, p in DISTINCTIVE]
    steps += [(product.isin(*names.split("|")), s) for s, names in SPECIFIC.items()]
    steps += [(text.rlike(f"(?i){p}"), s) for s, p in KEYWORDS]
    steps += [(product.isin(*names.split("|")), s) for s, names in GENERIC.items()]
    steps += [(category == c, s) for c, s in FALLBACK.items()]
    chain = F
    for condition, sector in steps:
        chain = chain.when(condition, sector)
    return chain.otherwise("other")
