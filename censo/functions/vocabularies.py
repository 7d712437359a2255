"""Fixed vocabularies of the registry's cleaning and classification, as values; the rules that use them are elsewhere."""

from __future__ import annotations


def _spellings(text: str) -> dict[str, str]:
    """'name: a | b' lines as {a: name, b: name}."""
    lines = [line.split(":", 1) for line in text.strip().splitlines()]
    return {s.strip(): name.strip() for name, values in lines for s in values.split("|")}


# Administration routes and the (folded) spellings of each.
ROUTES = _spellings("""
oral: oral | oral use | in drinking water use
sublingual: sublingual use
buccal: buccal use
oromucosal: oromucosal use
enteral: enteral feeding tube | oral, nasogastric tube or percutaneous endoscopic gastrostomy tube use
intravenous: intravenous | intravenous use | intravenous infusion | intravenous administration | intravenous injection | intravenous perfusion use | intravenous drip use | intravenous drip | intravenous bolus use | intravenous slow bolus injection | direct intravenous injection | iv infusion | solution for intravenous infusion | infusion intravenosa | intravenious infusion | intravenus use | infusion | solution for infusion | concentrate for solution for infusion | intravascular use | intravenous bolus injection/iv infusion | iv injection, iv infusion
subcutaneous: subcutaneous | subcutaneous use | subcutaneous injection | subdermal use
intramuscular: intramuscular | intramuscular use | intramuscular injection
inhalation: inhalation | inhalation use | inhalation gas | inhalational route
nasal: nasal use | nasal spray | intranasal use
intratracheal: intratracheal use | endotracheopulmonary use
topical: topical | topical use | topical application | topical administration | topical application on wound
cutaneous: cutaneous | cutaneous use
transdermal: transdermal use
percutaneous: percutaneous use
intradermal: intradermal | intradermal injection | intraepidermal use
ocular: ocular | ocular use | ophthalmic | ophthalmic use | eye/ear/nose drops
conjunctival: conjunctival use | subconjunctival use
intravitreal: intravitreal use
subretinal: subretinal use
suprachoroidal: suprachoroidal
intracameral: intracameral use
retrobulbar: retrobulbar use
intrathecal: intrathecal | intrathecal use | i.t. bolus injection to the intrathecal space
intracisternal: intracisternal use | cisterna magna puncture (icm)
intracerebroventricular: intracerebroventricular (icv) | intraventricular use
intracerebral: intracerebral use
epidural: epidural use
perineural: perineural use
intratumoral: intratumoral | intratumoral use
peritumoral: peritumoral use
intralesional: intralesional use
intravesical: intravesical use
intraperitoneal: intraperitoneal use
intraarterial: intraarterial use
intracoronary: intracoronary use | antegrade epicardial coronary artery infusion
intraarticular: intra-articular injection | intraarticular use
intraosseous: intraosseous use
intrabursal: intrabursal use
intralymphatic: intralymphatic use
intraamniotic: intraamniotic use
intracochlear: intracochlear | intracochlear injection
auricular: auricular use
dental: dental use
vaginal: vaginal use
rectal: rectal use
extracorporeal: extracorporeal use
implantation: implantation
transplantation: transplantation
infiltration: infiltration | local injection
injection, route unspecified: injection | solution for injection | injectable solution | solution for injection in pre-filled syringe
parenteral, route unspecified: parenteral | parenteral use
multiple routes: oral and iv | intravenous use and oral use | intravenous (iv) or subcutaneous (sc) | subcutaneous and intravenous use | subcutaneous or intravenous | intramuscular or subcutaneous | intramuscular or intravenous | intravenous/subcutaneous/intramuscular | intravenous, intra-arterial, intrathecal use | intravenous injection/infusion, intramuscular injection | solution for injection or infusion | infiltration, perineural use
""")
# Fixed values: (folded) texts that name no route.
NOT_A_ROUTE = ("unknown use", "other use", "route of administration not applicable", "new", "spc")
# Groups of routes.
ROUTE_GROUPS = _spellings("""
oral: oral | sublingual | buccal | oromucosal | enteral
intravenous: intravenous
subcutaneous: subcutaneous
intramuscular: intramuscular
parenteral, unspecified: injection, route unspecified | parenteral, route unspecified
respiratory: inhalation | nasal | intratracheal
skin: topical | cutaneous | transdermal | percutaneous | intradermal
ocular: ocular | conjunctival | intravitreal | subretinal | suprachoroidal | intracameral | retrobulbar
central nervous system: intrathecal | epidural | intracisternal | intracerebroventricular | intracerebral | perineural
other parenteral: intraarterial | intracoronary | intraperitoneal | intraosseous | intralymphatic | intraamniotic | extracorporeal
local or regional: intratumoral | peritumoral | intralesional | intravesical | intraarticular | intrabursal | infiltration | intracochlear | auricular | dental | vaginal | rectal | implantation | transplantation
multiple routes: multiple routes
""")

# Classes of sponsors, and the patterns of names that speak for a company or a public body (any case).
INDUSTRY, ACADEMIC, UNCLASSIFIED = "Industry", "Academic or public", "Unclassified"
INDUSTRY_MARKERS = (
    r"\bS\.?A\.?U?\.?\b", r"\bS\.?L\.?U?\.?\b", r"\bInc\b", r"\bLtd\b", r"\bLimited\b", r"\bGmbH\b", r"\bLLC\b", r"\bAB\b", r"\bA/S\b", r"\bN\.?V\.?\b", r"\bB\.?V\.?\b",
    r"\bAG\b", r"\bPlc\b", r"\bS\.?p\.?A\b", r"\bCorp", r"\bCo\.", r"\bKG", r"\bOy\b", r"\bAp[Ss]\b", r"\bS\.?A\.?S\b", r"\bSE\b", r"\bSPRL\b", r"\bSARL\b", r"\bLLP\b",
    r"\bUnlimited\b", r"Pharma", r"Laboratori", r"Biotech", r"Bioscience", r"Therapeutic", r"\bSciences?\b", r"\bMedicament", r"\bBiopharm", r"Recherche", r"\bIndustri",
)
ACADEMIC_MARKERS = (
    r"\bHospital", r"\bUniversi", r"\bFundaci", r"\bFoundation\b", r"\bServicio\b", r"\bServei\b", r"\bSociedad\b", r"\bSociety\b", r"\bAsociaci", r"\bConsorci", r"CIBER",
    r"\bGrupo\b", r"\bCentro\b", r"\bCentre\b", r"\bAgencia\b", r"\bColegio\b", r"\bComplejo\b", r"\bCl[ií]nic", r"\bIIS\b", r"IDIBAPS", r"\bInstitut", r"\bAcadem",
    r"\bMinisteri", r"\bConsejer", r"\bGeneralitat", r"\bJunta\b", r"\bOrganisation\b", r"\bNetwork\b", r"\bCollege\b", r"\bTrust\b",
)
# Fixed value: the titles that open a person's name.
PERSONAL_TITLE = r"^(Dr|Dra|D|Da|Don|Doña|Prof|Sr|Sra|Mr|Ms|Mrs)\b\.?\s"
INDIVIDUAL = "Individual investigator"
# Families of companies by pattern (any case), the first that fits counts.
FAMILIES = (
    (r"Sanofi Pasteur MSD", "Sanofi Pasteur MSD"), (r"Merck Sharp ?(&|and) ?Dohme", "Merck Sharp & Dohme (MSD)"), (r"Merck (KGaA|Healthcare)", "Merck KGaA"),
    (r"\bRoche\b", "Roche"), (r"\bNovartis\b", "Novartis"), (r"AstraZeneca", "AstraZeneca"), (r"\bJanssen\b", "Janssen (Johnson & Johnson)"), (r"\bAbbVie\b", "AbbVie"),
    (r"\bPfizer\b", "Pfizer"), (r"GlaxoSmithKline", "GlaxoSmithKline"), (r"Bristol[- ]?Myers Squibb", "Bristol Myers Squibb"), (r"\bSanofi\b", "Sanofi"), (r"\bLilly\b", "Eli Lilly"),
    (r"Boehringer", "Boehringer Ingelheim"), (r"\bAmgen\b", "Amgen"), (r"\bBayer\b", "Bayer"), (r"\bGilead\b", "Gilead"), (r"\bCelgene\b", "Celgene"), (r"\bIncyte\b", "Incyte"),
    (r"\bTakeda\b", "Takeda"), (r"\bServier\b", "Servier"), (r"\bAstellas\b", "Astellas"), (r"\bIpsen\b", "Ipsen"), (r"\bGenentech\b", "Roche"), (r"\bGenzyme\b", "Sanofi"),
    (r"\bMedImmune\b", "AstraZeneca"), (r"Millennium Pharmaceuticals", "Takeda"), (r"\bUCB\b", "UCB"), (r"\bEisai\b", "Eisai"), (r"ViiV Healthcare", "ViiV Healthcare"),
    (r"\bBeiGene\b|\bBeOne Medicines\b", "BeiGene (BeOne Medicines)"), (r"Medica Scientia Innovation Research", "Medica Scientia Innovation Research (MedSIR)"),
)
