"""Canonical digests of full licence texts.

Fixed values, made with `licenses.canonical` of the texts as published, with and
without title lines, preambles and closing appendices: (license_id, SHA-256 of the
canonical form, its length, its first 32 letters, whether it is the core that the
licence's other forms hold).
"""

FULL = [
    ("0BSD", "0a3c6d8cba4008f8f77f9523dfd7dd4abe732b42587979e10d17dde7e8a38e99", 590, "permission to use copy modify an", True),
    ("0BSD", "73dd41a4b4752165792ec1c2b5c700f114053545ead2443a9599eb883e52b83b", 606, "zero clause bsd permission to us", False),
    ("0BSD", "59365598e3c06093a62c91ea2efd18b81980f22fc64c9affc985d3ef18d3ef92", 614, "bsd zero clause license permissi", False),
    ("Apache-2.0", "eb5530041b6ea17d477f6852abf71a41c900ceab5a78d9f98709db07fac68143", 8117, "1 definitions license shall mean", True),
    ("Apache-2.0", "1a9d5dc25b3937c10040abbf2ced955e40e9830cd2d8b129b6dd6f1f4d8176c8", 8176, "terms and conditions for use rep", False),
    ("Apache-2.0", "f3b0e478d916e7d669319cb1d5f041e69ff23b577aa852fbe29a7b5439908890", 8232, "apache license 2 0 january 2004 ", False),
    ("Apache-2.0", "9e71813646a49e037b3488cc918418ec07ed765b607532c64cfb1fe087625488", 8729, "1 definitions license shall mean", False),
    ("Apache-2.0", "2a22abde2e3cce5f233acd8ccbd2aedf471badfad4b6015f024c4bffcdb37327", 8788, "terms and conditions for use rep", False),
    ("Apache-2.0", "f9a8e6983f1dc4ced6c35ea39547337799ffc71efc34667b60c23ee2f7051372", 8844, "apache license 2 0 january 2004 ", False),
    ("Apache-2.0", "680d2f4624144c01e259aaf5cf21549e0eb580a7397818808d8713171452c882", 9732, "1 definitions license shall mean", False),
    ("Apache-2.0", "33fe867b2a72bb13615bb58d1df6ea5b2ac6ba463ddb89c622841418916c7f37", 9791, "terms and conditions for use rep", False),
    ("Apache-2.0", "85c255147d02a1e41dc2dced07a6cf527f58c3480fa9510015bbc41b019a6df1", 9847, "apache license 2 0 january 2004 ", False),
    ("BSD-2-Clause", "af5280fe5290abff6c81496b2430fa3ae4506a40df2cd4b45e8d5729e5615ac1", 1139, "redistribution and use in source", True),
    ("BSD-2-Clause", "cb73dcd9637076ab7be4e429967783087c5b3f1b376918533697a5142839a8d9", 1143, "redistribution and use in source", True),
    ("BSD-2-Clause", "6e4b41ef83676398278c1d8b470269fa29740f5b87af72a01c7f1617be67a798", 1151, "bsd license redistribution and u", False),
    ("BSD-2-Clause", "984f86e4fbcd2b6fbc3d956ed92c2420141123674cc7d1ed75c28536524ad849", 1155, "bsd license redistribution and u", False),
    ("BSD-2-Clause", "5c176d7d235de8d6e4247af6382b33c2c620fa1f81255b4c59cbadfd094b5c8e", 1160, "bsd 2 clause license redistribut", False),
    ("BSD-2-Clause", "bf51618b53f2270d04bbfb43b2a1ec9f09ee6548b7c77f612d7fbc0bfa078ca4", 1164, "the bsd 2 clause license redistr", False),
    ("BSD-2-Clause", "2218eed096db71f1538862718852e8beca4abfaee61128a0e1678005d31bb9de", 1164, "bsd 2 clause license redistribut", False),
    ("BSD-2-Clause", "cbb5bf64374a5f606db3255dd54f0fe9fcfeaff34fab6af9a70d561b62fe4570", 1166, "simplified bsd license redistrib", False),
    ("BSD-2-Clause", "f4b593d5bc03b46b65d8fac4dc7a9b2f38d3a484e70b15160bce1c823e6fe0f7", 1168, "the bsd 2 clause license redistr", False),
    ("BSD-2-Clause", "19111d6a47bc463c3b6ce30beb05621917e59c9532aa87c1b63843e21f128ab3", 1168, "the 2 clause bsd license redistr", False),
    ("BSD-3-Clause", "56019f5f5c0d604e8bf4a9a27846d8e414fce4864a7b43ac848ee4452b97957f", 1316, "redistribution and use in source", True),
    ("BSD-3-Clause", "1db6dd384613154fa62fd0477f795222008b7063196d6ceb94d390f9df7abb4c", 1322, "redistribution and use in source", True),
    ("BSD-3-Clause", "b825864bb476bbd3a60c6c8bf1c5bdcbffaff9f3db8bb2cb42ad8dbd2dab395a", 1328, "bsd license redistribution and u", False),
    ("BSD-3-Clause", "74ea59c7493ec7c075dd0057e42b0f7747912955b49947b741d19bfe2db400cd", 1332, "new bsd license redistribution a", False),
    ("BSD-3-Clause", "de8216564cb3f293315a992e3d5da29e55c688bd9fc3144fc20745264cac262e", 1334, "bsd license redistribution and u", False),
    ("BSD-3-Clause", "cda6be28edb0d4f65dd1eabad98af9d3b4e0ca8da39c73edb50c0cb4319cfa50", 1337, "bsd 3 clause license redistribut", False),
    ("BSD-3-Clause", "38a3c1839fe5b7e0c47b194e259741c0160d73a0e4769dc0a039f84243813a8c", 1338, "new bsd license redistribution a", False),
    ("BSD-3-Clause", "87971b70f196bb74c2485f4f879b7b53754d054ab08b9d1fcd34cc58966206f4", 1341, "the bsd 3 clause license redistr", False),
    ("BSD-3-Clause", "989c1252a668c03e4e608e579d20bc2ef966e3235d921136f1be97a0b1e89a4e", 1343, "bsd 3 clause license redistribut", False),
    ("BSD-3-Clause", "5ef180def7d2073672d30bd79140c8051748c35b84a7f6c660ee918d8f206ee9", 1347, "the bsd 3 clause license redistr", False),
    ("BSD-3-Clause", "787f2e50bca31e729074e4060f7eca9597ca918cbfe1f1aa3d196a1e62e44204", 1347, "the 3 clause bsd license redistr", False),
    ("BSL-1.0", "ca1a8e0c8181fe6bfe94d2186c3b3f3619c8a8bb04b6857014ff5d0d7eec87fb", 1194, "permission is hereby granted fre", True),
    ("BSL-1.0", "ff53c86cc09aa5dcb914e68faa627eed58adeabdda6c3573838a6d525c5bdab5", 1238, "boost software license 1 0 augus", False),
    ("CC0-1.0", "af078be23a79bc0f0c0b2268b1cdc885abe97f6a1146407a884c557371d43c96", 6174, "statement of purpose the laws of", True),
    ("CC0-1.0", "1815b1711bbecf90bd98e97f2ff2a61169506a4a1ebecf48acdffee888c3c49c", 6684, "creative commons legal code cc0 ", False),
    ("GFDL-1.2", "327ff9f3e63e719cc45899ef05080eafb12108bce472a46ebddb166b461a8818", 17969, "preamble the purpose of this lic", True),
    ("GFDL-1.2", "ea0b6c51e5f4795435334b41b0c75fafb75fc99097fa3281d9b7339dd872cefb", 18189, "gnu free documentation license 1", False),
    ("GFDL-1.2", "7252bd7bccc03b015f3d30bedfd032bf71c373f4a4dfe79399cf0c0c9e9c603d", 19150, "preamble the purpose of this lic", False),
    ("GFDL-1.2", "ed4ad8e387d520ed5925efb355fefc7a73b86146a9ca19d381743ac6381bc5ca", 19370, "gnu free documentation license 1", False),
    ("GFDL-1.3", "da4b2133a5dff7f92634263ca693cfee66e3c91c6447b5f7ad342c4470fc89e2", 20425, "preamble the purpose of this lic", True),
    ("GFDL-1.3", "229642975f5d60890cc4f8acb9eae97717488cea3c7c0b8c2ebe27c05889b17e", 20603, "gnu free documentation license 1", False),
    ("GFDL-1.3", "082693eaf0b65961c412f43dd8d1fb58181467fa641711bb42d54445c80d31db", 21606, "preamble the purpose of this lic", False),
    ("GFDL-1.3", "ec42336af2285add31479057c21a0a4b783f8d4ca5d50bee8067c1afeac88b76", 21784, "gnu free documentation license 1", False),
    ("GPL-1.0", "7659ea3b3d6e0f6701bbe141b6dcea283566d00068afed5064afdff9c04c128a", 7069, "this license agreement applies t", True),
    ("GPL-1.0", "bb4d855a4c3ee172ad89333b53904dc8fb6a0d6816a801621b7a4de1761d96c8", 7097, "this license agreement applies t", False),
    ("GPL-1.0", "caafce074c2f1252073f4353068b2a04e294067e34d307032d0ec7e4d86f437d", 9111, "preamble the license agreements ", False),
    ("GPL-1.0", "e0686bd520183f319e20e462697b0dcfbc5966da1624ae22b590f797a1051d03", 9139, "preamble the license agreements ", False),
    ("GPL-1.0", "81da11ca411d9d6436124dfe3156dde613b606f7a78772a7b1b2250d665186bb", 9323, "gnu general public license 1 feb", False),
    ("GPL-1.0", "7aca3d14eb6d46b5bf6c0279c2ed5a8c2a2ed56f132c1ff4e272f8f6f2fcf158", 9351, "gnu general public license 1 feb", False),
    ("GPL-1.0", "b2b121a9cf7a4af973c5309cce17ea2e86728afd543d27d9413a2b817a9bdd6c", 9431, "this license agreement applies t", False),
    ("GPL-1.0", "8a13748640fca5c91ef25388e7cf9880b2e24edc1619be11555f8e06041bf302", 11473, "preamble the license agreements ", False),
    ("GPL-1.0", "0e3a6e6ec3574e464befa1da7e02619e6d39551648d59a3ae3b15214354a6cf1", 11685, "gnu general public license 1 feb", False),
    ("GPL-2.0", "a10c3170bbe899421da4e5b1e639ed1c7a8dec78457ffa496be49f8e146a78cc", 11644, "this license applies to any prog", True),
    ("GPL-2.0", "0aad2ad9200354a0c47c1c732b29c822b0cbc3fb4a540d1b9636e9a35e05c8df", 11672, "this license applies to any prog", False),
    ("GPL-2.0", "fe7901a936bf664f9b5dd0be8a703a744b5aa0f454c822ad286c143c792d33c0", 14179, "preamble the licenses for most s", False),
    ("GPL-2.0", "09fdb98ec8cccd7bceabfe2a376b85233431035469aaa8c7f8dc7b62eb795f22", 14207, "preamble the licenses for most s", False),
    ("GPL-2.0", "592f0aa19767ea8adf184cefaadbe2905c0698a423b9b3847b40621661c6a9ba", 14290, "this license applies to any prog", False),
    ("GPL-2.0", "1ec867849dd33f66635d85d213fc117d482d7ee31ea577b95cbb9c80a5003519", 14391, "gnu general public license 2 jun", False),
    ("GPL-2.0", "c6a6a8752257b86c1691e9e7f3e86d4d696bbfaaa3f585be877c82f2291f2c66", 14419, "gnu general public license 2 jun", False),
    ("GPL-2.0", "efa5abacd37322c2020f736b202ac5d4cb177ca8d7a7da2b8cb91fc24ba6ce3b", 16825, "preamble the licenses for most s", False),
    ("GPL-2.0", "9c8439f8efcf5accf81009202bc986cd815f684f7c120466fe2807ed6b9791eb", 17037, "gnu general public license 2 jun", False),
    ("GPL-3.0", "3cd4f55f53f72c7288d3d9ab8be8e6b069811c4c459b8ca4fb9ae7b978fab182", 27458, "definitions this license refers ", True),
    ("GPL-3.0", "b34353b2b8d4ab4419c5ae53b9bce51070f6b600a415d127ce7620c892778911", 27486, "definitions this license refers ", False),
    ("GPL-3.0", "3e690dde4155e9876075eb2d4186510d2f3bc2869d1338a1f077119deb9169dc", 29901, "definitions this license refers ", False),
    ("GPL-3.0", "6c8225151b45f012135050a5d75c5a8efe00c6bb8a9258d7f225ab367efd6c9f", 30669, "preamble the gnu general public ", False),
    ("GPL-3.0", "2c0415031c1032b610bcccade8e8205085757b35f6087dadbc46500238ea3ff1", 30697, "preamble the gnu general public ", False),
    ("GPL-3.0", "c5f344c04e43271d5daaf1dfbf10b58f93cee25af214cb5f4298940d47d45001", 30828, "gnu general public license 3 29 ", False),
    ("GPL-3.0", "15c07cd4ab89ca5795965e02e8dc5b5cc8c5677132e6fd3061056a82701432d0", 30856, "gnu general public license 3 29 ", False),
    ("GPL-3.0", "a9452e7df1af2369e94a21df02e50a6f1438541388e909279fbd7a1207a4db4c", 33112, "preamble the gnu general public ", False),
    ("GPL-3.0", "53649bb2b9cc912eb496721fe8a1c91dbc32bf3c8cbad2d16161fd440c8c5181", 33271, "gnu general public license 3 29 ", False),
    ("ISC", "0836ad9a214c5439e88de5061e128140b2d965cf75479e6b368f8782ce8d0e0a", 679, "permission to use copy modify an", True),
    ("ISC", "a62954ccd76ca01f68871213bdb383bcbe7e2eaa13ea82cd724536e35bdda38c", 689, "permission to use copy modify an", True),
    ("ISC", "b080c5721b3a3c7ce9371f16f4a118a6658ca5d0dcba04382b4ea74acb8f4096", 691, "isc license permission to use co", False),
    ("ISC", "ad4194e34315617ed91812897603901a5a8931963fa1668f0a90211a44c88bc4", 695, "the isc license permission to us", False),
    ("ISC", "502187a1a8b29776054a4121b2102da5e2c1ec765f2f06ab252f464c6ee568d3", 695, "isc license isc permission to us", False),
    ("ISC", "510724a0bd15f45afd53821b777d369f9508292f8d2686e787bfb1b10ff07a90", 701, "isc license permission to use co", False),
    ("ISC", "efe829e3ba7855f521338c1b3409d545e70008b2017427fa6ea15389423e45d1", 705, "the isc license permission to us", False),
    ("ISC", "b7d2ff3a82a558623c6e443d0b44056b7f6f01a553838789e47cc9291d712730", 705, "isc license isc permission to us", False),
    ("LGPL-2.0", "8a6f266e0a1100ebd9d645b247ef5804181996fca8fbf32e8f2e2a8b3e362770", 16997, "this license agreement applies t", True),
    ("LGPL-2.0", "ae786ef3d5b4901cae00a2c8cfa534059c168a300aa0b89532198431ccd39d25", 17025, "this license agreement applies t", False),
    ("LGPL-2.0", "f98ee680044289d29ba3be91a11cba3d757bc48d3bb17570fb29980c17e6a8d4", 18870, "this license agreement applies t", False),
    ("LGPL-2.0", "2d6aa76699e661e45fa2baa48bb52d9c35c1e4c105fff2a21e69b85248e42df0", 21811, "preamble the licenses for most s", False),
    ("LGPL-2.0", "5c40e5604156cb54759639f7605f85a6b28fe7f91a7b85fe47ee7230096ec43e", 21839, "preamble the licenses for most s", False),
    ("LGPL-2.0", "d47a7e85077595a839b85c7a5bf502976caad2b230462db4ca9c21f0c9b4b85a", 22137, "gnu library general public licen", False),
    ("LGPL-2.0", "c4d6372ccc3952ce4f8deba3ddf4c08ddcff16ab005bb771113acffe07ee898c", 22165, "gnu library general public licen", False),
    ("LGPL-2.0", "f5737dbdf51af298af14203ce2ad3e0456036a1076ab945b0359419e6e9c51df", 23684, "preamble the licenses for most s", False),
    ("LGPL-2.0", "0065a77033acc3b3003d60fdf01813c2c3822a31956ca79c0cdaa90676c66e98", 24010, "gnu library general public licen", False),
    ("LGPL-2.1", "aa1533d66338f4a2a69cb793dbbd25fb7cfc38c903f5899f10be53142fe44680", 17436, "this license agreement applies t", True),
    ("LGPL-2.1", "398fbd60a6fc73c4fa183807f2edbf5a7c27481f87ace7500420faeffa458bcf", 17464, "this license agreement applies t", False),
    ("LGPL-2.1", "ead34e84f0367221d8d8a8c0116f552adcf957fb62da7d2e3a66104d222836ed", 19308, "this license agreement applies t", False),
    ("LGPL-2.1", "676803e809489662fe9b2379373bc4a80d1ef7ae269f672dcc04afdb9a406a45", 22818, "preamble the licenses for most s", False),
    ("LGPL-2.1", "126bc33955088b3fe7b2f49f1788a849a913e423d84cb683f90707a6bbd4eb88", 22846, "preamble the licenses for most s", False),
    ("LGPL-2.1", "4ce8713cae454c2a5ae3969d2b78ad8fb5f7051c7957d5b17646378550d88dc5", 23177, "gnu lesser general public licens", False),
    ("LGPL-2.1", "984e8fa993cc1edb72646090297a9bc7aac37856422bb6b045320b4afa2d4995", 23205, "gnu lesser general public licens", False),
    ("LGPL-2.1", "709e9424ab33a53cf8d43f5a484643d8bc0fcab097e6d97dffee4b80808258ee", 24690, "preamble the licenses for most s", False),
    ("LGPL-2.1", "7f1b786219dba7cf963a46aef0267e74a4234133c2ca17d54e08223cbb24b6ab", 25049, "gnu lesser general public licens", False),
    ("LGPL-3.0", "f940bc24b05085d27216df4b90ca5f4090d758b459d47cc4fbdc8b4e050772d0", 6778, "this of the gnu lesser general p", True),
    ("LGPL-3.0", "98e2fed4834af5ebe4794fbacccb4555efb8b9dd309d989a47c1d4ac3cf8bae1", 6944, "gnu lesser general public licens", False),
    ("MIT", "1bbd3b61db28e5625db087de0418387040f9d337a205bf583de7e4e69783ef48", 966, "permission is hereby granted fre", True),
    ("MIT", "be77903434baf13e539831c0c8e8b0c14f746633cbb91b49f953649b79285104", 970, "mit permission is hereby granted", False),
    ("MIT", "a380a2d88898a0b21fd46403346b281fb073da29a617ac13e60704ac9b5b7be3", 978, "mit license permission is hereby", False),
    ("MIT", "693e8006ff29df96b251ae7353c310e866d414c17fbc403d3fa127e20cab6629", 978, "license mit permission is hereby", False),
    ("MIT", "6b48ef27439372cb46752d75ae62a6be3740e4c9c139db9197f4b1e70060622b", 982, "the mit license permission is he", False),
    ("MIT", "a860374a14d18a7451b3f4aab3ef76dedb559bac763efa802d60ccb759a8215f", 986, "the mit license mit permission i", False),
    ("MPL-1.1", "c81d25534d7ed7fc11fa2af71f861a35c17fdbcbe2471154308de82f66b5d92d", 20792, "definitions 1 0 1 commercial use", True),
    ("MPL-1.1", "75dd9a6b352e6f492dae5dbd37cacffdc95441d986be9a032453134bfeb1e3eb", 20821, "mozilla public license 1 1 1 def", False),
    ("MPL-1.1", "92d3cca9ee31a04fe188794353ecd666cfbe4e927181c96035bf57bd5dee4462", 22157, "definitions 1 0 1 commercial use", False),
    ("MPL-1.1", "fd8b3cd6430575d58b7ce37cec42751cb270cdf37a447229c7c2c9eb4a7bdbc1", 22186, "mozilla public license 1 1 1 def", False),
    ("MPL-2.0", "b1aad75516a74cc3ab1074e3993f00205ef46631dbaa0b8a048025267d4ada37", 13570, "definitions 1 1 contributor mean", True),
    ("MPL-2.0", "7e5f7080533aed2362dabc38ac197b84b0c8fa3ef80a8303d427b4ab35ff4841", 13599, "mozilla public license 2 0 1 def", False),
    ("MPL-2.0", "31d468d2ae255b5044bc2200cc0ba15d36c74c2cf44d0ff6745c4d7d5c424796", 14199, "definitions 1 1 contributor mean", False),
    ("MPL-2.0", "c1dbb14123bd663b5ca7a38f281c59f7de35a045bc5523fe64b31a708ada5350", 14228, "mozilla public license 2 0 1 def", False),
    ("Unlicense", "761a8706c5893d446d665605662541f6c8c4cfaf66050e7e117d2293149018a7", 1114, "this is free and unencumbered so", True),
    ("Unlicense", "49d6fc33caecfc9fe20c47425ab4fa49e379e986e0f56b758566937adf8beb64", 1128, "the unlicense this is free and u", False),
    ("Unlicense", "a167fb4fa9f9c998c858a3fd23d123b81125066bf3051239cb8d7190224bd59e", 1165, "this is free and unencumbered so", False),
    ("Unlicense", "0dd29327d0d6edc23548daeb80dfa0e2d7601c213a028d676929c4338df63070", 1179, "the unlicense this is free and u", False),
    ("Zlib", "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7", 784, "this software is provided as is ", True),
    ("Zlib", "99618428d879198d4ae824db7ad07a9d0f9214f15429de52839cbe667713f21a", 797, "zlib license this software is pr", False),
    ("Zlib", "ee37bc3ccba61ff28a10c05f28bdabf7466db400a75d9a1890fb865cda23e145", 801, "the zlib license this software i", False),
]
