"""The canonical family of 128 affine hash functions `(a * h + b) mod 2^32`."""

# Results are comparable only under these coefficients.
CANONICAL_A = (
    2461073977, 4068265167, 1963639998, 4188804150, 1597603359, 685210601, 2220169462, 1898454865,
    367060194, 3008642886, 1589030268, 1616821384, 3627590951, 1669470000, 2909847533, 4034144575,
    2718905707, 3446680356, 3421991419, 2621724595, 2758513502, 2668464211, 2183142999, 3427830900,
    1458577010, 83251161, 3799688785, 3419784521, 1640714226, 2936566898, 1948489329, 259256096,
    2715610451, 3569507854, 2683418592, 537015816, 167984908, 3112576337, 2847269432, 1409804995,
    1282483913, 2210268224, 2106705091, 3038709818, 551908191, 4055931993, 3932006546, 868676788,
    1224531371, 2761743448, 4044535515, 1632880471, 2831905232, 579290406, 2467764078, 1258232538,
    1514729904, 2084218199, 2971137878, 1892304382, 1251504018, 166958372, 3750459229, 2705136087,
    1980218234, 1655285799, 1411888306, 274801197, 3530907986, 2687838608, 4164046837, 3338013560,
    1123877287, 4058456770, 2401659054, 2330456067, 2229554264, 4091340450, 724655294, 2855898253,
    2536541683, 614327932, 3975927644, 3686331917, 2856101398, 3451404009, 3945427099, 1070379979,
    198527685, 1729907791, 3015599603, 3582146635, 774144649, 2823731578, 2521978147, 3813505280,
    2412448396, 3994089931, 1693971116, 185452569, 539341057, 1870045304, 1206121220, 519076618,
    1323465208, 4138483493, 307954332, 2337439688, 2308710946, 3744977555, 2368707081, 1716898113,
    940543714, 3343254572, 960393533, 2723891258, 1041544634, 3925195877, 3819006552, 4086973939,
    2260290730, 3954146092, 3210229665, 3050620709, 1197419521, 812692070, 943682205, 961395201,
)
CANONICAL_B = (
    1570419827, 2951223800, 2827355939, 2044102183, 4057428307, 2501719356, 3283176262, 507623698,
    1339505574, 3653461140, 3375066364, 380055397, 1015153906, 2580738893, 1117532264, 3925283057,
    3445071761, 2283374130, 2032022830, 4221739735, 855508289, 2570227961, 2786453719, 957193324,
    854515079, 2915303401, 1765661319, 1233653554, 1073987701, 2677611593, 706067201, 142690687,
    1937914976, 3486252055, 2505048854, 392547294, 3665222936, 3411224521, 940726855, 695079259,
    3025718235, 4290176028, 786745122, 612886497, 4175279516, 2112934219, 4240180129, 150792891,
    1399579579, 4233915487, 3049722581, 1752369884, 3329151360, 3933055975, 785109753, 4044942470,
    3663567947, 191090222, 2962989855, 4114663115, 2820197471, 2657135885, 1931482324, 4202328315,
    2627181833, 1711876737, 587922347, 411447709, 992781311, 2189879108, 283895015, 3632149727,
    1838354200, 3522342102, 1252390762, 513104615, 1271367373, 3877628913, 530593740, 1235237300,
    3196309764, 2432553243, 2027404774, 437964364, 2480347037, 1155688848, 857969502, 2959479920,
    149314159, 10261167, 3800455136, 3381359135, 3209115848, 1043937696, 980440598, 2313495643,
    1121275014, 433096834, 1686340418, 4030932736, 3021657628, 1598334742, 4197833321, 3099140232,
    1935505811, 870742622, 132325799, 1260723603, 353860042, 2882637216, 2397180549, 1036096199,
    1361981717, 3216170423, 2090664817, 1427339081, 1608234190, 2577297807, 2846206486, 2467163145,
    1948467913, 1809780980, 2478479022, 1203199685, 1274100715, 2791776856, 2201133065, 2810274986,
)
