"""They must equal the published ones for results to agree."""

# classes
BACKGROUND, TISSUE, COAGULATION, ABLATION = 0, 1, 2, 3
N_CLASSES = 4
CLASS_NAMES = ["Background", "Tissue", "Coagulation", "Ablation"]
PALETTE = {0: (255, 255, 255), 1: (0, 255, 0), 2: (0, 0, 255), 3: (255, 0, 0)}

# physical scale, micrometres per pixel
UM_PER_PX = 0.884          # morphometry
UM_PER_PX_FILTER = 0.8832  # component filter and pyramid target
PERIPHERAL_EDGE_UM = 500.0

# component filter
MIN_DIAMETER_UM = 80.0
EDGE_SMALL_UM = 150.0
TAUS = [0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
EDGE_DISTANCES = [0.0, 50.0, 100.0, 150.0]
REAL_OVERLAP = 0.2
RIM_UM = 10.0

# discovery
EXCLUDED_FOLDERS = ["tile_mask_bkp", "predictions", "test"]

# radial zones, upper bounds of the bin's middle
ZONES = [(0.25, "Central"), (0.5, "Stable"), (0.75, "Transition"), (1.0, "Peripheral")]
