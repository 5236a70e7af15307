"""The published reference norms of 1485 GUI screenshots.

Columns: n, mean, std, min, max, p5, p25, p50, p75, p95.
"""

from __future__ import annotations

STATS = ["n", "mean", "std", "min", "max", "p5", "p25", "p50", "p75", "p95"]

REFERENCE_NORMS = {
    "shannon_entropy": {
        "n": 1485,
        "mean": 4.284122420365763,
        "std": 1.8155600576156246,
        "min": 0.11742080003023148,
        "max": 7.806893825531006,
        "p5": 1.4298035383224488,
        "p25": 2.8303096294403076,
        "p50": 4.293789863586426,
        "p75": 5.745741844177246,
        "p95": 7.21705436706543,
    },
    "edge_density": {
        "n": 1485,
        "mean": 0.03511815832368487,
        "std": 0.019242493324386205,
        "min": 0.0015890031375543256,
        "max": 0.12311157640937788,
        "p5": 0.009781041279782207,
        "p25": 0.01946484375,
        "p50": 0.03227708333333333,
        "p75": 0.04797625,
        "p95": 0.07056653122080155,
    },
    "feature_congestion": {
        "n": 1485,
        "mean": 4.163129171650469,
        "std": 1.5071473580910366,
        "min": 1.3361419706208149,
        "max": 9.746132516641362,
        "p5": 2.122411996930383,
        "p25": 2.9701401608942617,
        "p50": 3.9182808131035842,
        "p75": 5.179240205131224,
        "p95": 6.9367595739694625,
    },
    "subband_entropy": {
        "n": 1485,
        "mean": 2.80444116859369,
        "std": 0.7408821205913673,
        "min": 0.5799235520170234,
        "max": 4.6796643974678425,
        "p5": 1.5041178583475538,
        "p25": 2.278283815073473,
        "p50": 2.88261912747383,
        "p75": 3.380990512419458,
        "p95": 3.851908188650774,
    },
    "layout_symmetry": {
        "n": 1485,
        "mean": 0.33972811397929936,
        "std": 0.21350654137662164,
        "min": 0.0,
        "max": 0.9587909105829169,
        "p5": 0.052287065834259024,
        "p25": 0.17527409981521191,
        "p50": 0.29448559716537825,
        "p75": 0.4691212131658466,
        "p95": 0.7453875188235412,
    },
    "chromatic_coherence": {
        "n": 1485,
        "mean": 0.40734685630109674,
        "std": 0.13941960359631728,
        "min": 0.04461433368578276,
        "max": 0.8144109902637784,
        "p5": 0.16234784384823006,
        "p25": 0.3204998052813579,
        "p50": 0.4148564080195319,
        "p75": 0.5009206246670906,
        "p95": 0.6313817117312617,
    },
    "visual_hierarchy": {
        "n": 1485,
        "mean": 0.4481174863876943,
        "std": 0.17115848741224168,
        "min": 0.027182062473620178,
        "max": 0.8001917823806874,
        "p5": 0.15786865265074312,
        "p25": 0.3080780725105834,
        "p50": 0.47341819419310605,
        "p75": 0.5827336502881795,
        "p95": 0.699286182407285,
    },
    "interactive_element_density": {
        "n": 1485,
        "mean": 0.2618807261907699,
        "std": 0.2484545710003041,
        "min": 0.0,
        "max": 1.8711419753086418,
        "p5": 0.014513521457965901,
        "p25": 0.09765625,
        "p50": 0.1880787037037037,
        "p75": 0.35603841145833337,
        "p95": 0.7242822300890684,
    },
    "saliency_dispersion": {
        "n": 1485,
        "mean": 0.42576092244297825,
        "std": 0.0676255724386525,
        "min": 0.188627858006745,
        "max": 0.635960031540322,
        "p5": 0.3072644530682006,
        "p25": 0.3823874804038033,
        "p50": 0.4282410028789261,
        "p75": 0.4721730715894864,
        "p95": 0.5305700837882615,
    },
    "saliency_peak_count": {
        "n": 1485,
        "mean": 5.302356902356903,
        "std": 2.444979694826603,
        "min": 1.0,
        "max": 16.0,
        "p5": 2.0,
        "p25": 4.0,
        "p50": 5.0,
        "p75": 7.0,
        "p95": 10.0,
    },
    "saliency_center_bias": {
        "n": 1485,
        "mean": 0.37870445496286576,
        "std": 0.16953221241854366,
        "min": 0.015040045129129714,
        "max": 0.9123994158415045,
        "p5": 0.10512022220939994,
        "p25": 0.26094721844258156,
        "p50": 0.3735376345647607,
        "p75": 0.4839545759748858,
        "p95": 0.6745901720568083,
    },
    "saliency_entropy": {
        "n": 1485,
        "mean": 0.5661802106647673,
        "std": 0.1300871110717502,
        "min": 0.18423278625765385,
        "max": 0.9050404486859869,
        "p5": 0.34569771148967054,
        "p25": 0.4818876469241345,
        "p50": 0.566354531216026,
        "p75": 0.6546632898710814,
        "p95": 0.7775369205684891,
    },
    "saliency_coverage": {
        "n": 1485,
        "mean": 0.050841634964409355,
        "std": 0.0322806768255095,
        "min": 0.00806980056980057,
        "max": 0.20684461805555557,
        "p5": 0.013850764472404376,
        "p25": 0.027796768100309416,
        "p50": 0.04238001505533854,
        "p75": 0.06576979166666666,
        "p95": 0.11426340663580246,
    },
}
