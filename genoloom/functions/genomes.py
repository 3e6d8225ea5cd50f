"""Lengths of chromosomes of common reference genomes, and the species that go by them."""

from __future__ import annotations

from dataclasses import dataclass

# Chromosome lengths (bp) of published assemblies, in natural order.
LENGTHS: dict[str, dict[str, int]] = {
    "rice": {"1": 43270923, "2": 35937250, "3": 36413819, "4": 35502694, "5": 29958434, "6": 31248787,
             "7": 29697621, "8": 28443022, "9": 23012720, "10": 23207287, "11": 29021106, "12": 27531856},
    "arabidopsis": {"1": 30427671, "2": 19698289, "3": 23459830, "4": 18585056, "5": 26975502},
    "tomato": {"1": 90863682, "2": 53473368, "3": 65298490, "4": 64459972, "5": 65269487, "6": 47258699,
               "7": 67883646, "8": 63995357, "9": 68513564, "10": 64792705, "11": 54379777, "12": 66688036},
    "human_grch38": {"1": 248956422, "2": 242193529, "3": 198295559, "4": 190214555, "5": 181538259, "6": 170805979,
                     "7": 159345973, "8": 145138636, "9": 138394717, "10": 133797422, "11": 135086622, "12": 133275309,
                     "13": 114364328, "14": 107043718, "15": 101991189, "16": 90338345, "17": 83257441, "18": 80373285,
                     "19": 58617616, "20": 64444167, "21": 46709983, "22": 50818468, "X": 156040895, "Y": 57227415},
    "human_grch37": {"1": 249250621, "2": 243199373, "3": 198022430, "4": 191154276, "5": 180915260, "6": 171115067,
                     "7": 159138663, "8": 146364022, "9": 141213431, "10": 135534747, "11": 135006516, "12": 133851895,
                     "13": 115169878, "14": 107349540, "15": 102531392, "16": 90354753, "17": 81195210, "18": 78077248,
                     "19": 59128983, "20": 63025520, "21": 48129895, "22": 51304566, "X": 155270560, "Y": 59373566},
    "mouse_grcm39": {"1": 195154279, "2": 181755017, "3": 159745316, "4": 156860686, "5": 151758149, "6": 149588044,
                     "7": 144995196, "8": 130127694, "9": 124359700, "10": 130530862, "11": 121973369, "12": 120092757,
                     "13": 120883175, "14": 125139656, "15": 104073951, "16": 98008968, "17": 95294699, "18": 90720763,
                     "19": 61420004, "X": 169476592, "Y": 91455967},
    "mouse_grcm38": {"1": 195471971, "2": 182113224, "3": 160039680, "4": 156508116, "5": 151834684, "6": 149736546,
                     "7": 145441459, "8": 129401213, "9": 124595110, "10": 130694993, "11": 122082543, "12": 120129022,
                     "13": 120421639, "14": 124902244, "15": 104043685, "16": 98207768, "17": 94987271, "18": 90702639,
                     "19": 61431566, "X": 171031299, "Y": 91744698},
}

# Organism, assembly, key of LENGTHS and accepted spellings of each species.
KNOWN: dict[str, tuple[str, str, str, list[str]]] = {
    "rice": ("Rice (Oryza sativa, Nipponbare)", "IRGSP-1.0 / MSU7", "rice",
             ["oryza_sativa", "oryza sativa", "oryza_sativa_japonica", "irgsp", "irgsp1", "irgsp-1.0", "rice_irgsp1", "msu7", "msu", "rice_msu7", "japonica"]),
    "arabidopsis": ("Arabidopsis thaliana (Col-0)", "TAIR10", "arabidopsis",
                    ["arabidopsis_thaliana", "arabidopsis thaliana", "athaliana", "a. thaliana", "tair10", "tair", "arabidopsis_tair10"]),
    "tomato": ("Tomato (Solanum lycopersicum, Heinz 1706)", "SL4.0 (ITAG4.0 / ITAG4.1)", "tomato",
               ["solanum_lycopersicum", "solanum lycopersicum", "slycopersicum", "sl4.0", "sl4", "tomato_sl4", "itag4", "itag4.0", "itag4.1"]),
    "human": ("Human (Homo sapiens)", "GRCh38 / hg38", "human_grch38", ["homo_sapiens", "homo sapiens", "grch38", "hg38", "human_grch38"]),
    "human_grch37": ("Human (Homo sapiens)", "GRCh37 / hg19", "human_grch37", ["grch37", "hg19"]),
    "mouse": ("Mouse (Mus musculus)", "GRCm39 / mm39", "mouse_grcm39", ["mus_musculus", "mus musculus", "grcm39", "mm39", "mouse_grcm39"]),
    "mouse_grcm38": ("Mouse (Mus musculus)", "GRCm38 / mm10", "mouse_grcm38", ["grcm38", "mm10"]),
}


@dataclass(frozen=True)
class Species:
    """A species and its chromosome lengths, passed explicitly; there is no global choice."""

    name: str
    organism: str
    genome: str
    lengths: tuple[tuple[str, int], ...]

    def sizes(self, spark):
        """chr, length."""
        return spark.createDataFrame(list(self.lengths), "chr string, length long")


def species_key(name: str) -> str | None:
    """The known species that any accepted spelling stands for."""
    low = name.strip().lower()
    return next((k for k, (_, _, _, also) in KNOWN.items() if low == k or low in also), None)


def species(name: str, lengths: dict[str, int] | None = None) -> Species:
    """A known species, or any other with ``lengths`` of one's own."""
    key = species_key(name)
    if lengths is not None:
        return Species(key or name, KNOWN[key][0] if key else name, "own lengths", tuple(lengths.items()))
    if key is None:
        raise ValueError(f"no built-in lengths for {name!r}; known: {', '.join(KNOWN)}")
    organism, genome, at, _ = KNOWN[key]
    return Species(key, organism, genome, tuple(LENGTHS[at].items()))


def list_species(spark):
    """species, organism, reference_genome, chromosomes, size_mb."""
    rows = [(k, o, g, len(LENGTHS[at]), round(sum(LENGTHS[at].values()) / 1e6, 1)) for k, (o, g, at, _) in KNOWN.items()]
    return spark.createDataFrame(rows, "species string, organism string, reference_genome string, chromosomes long, size_mb double")
