"""States by the first digits of their PIN codes."""

from __future__ import annotations

#: The postal circles' prefixes, of which the longest that fits counts.
PIN_STATES = {
    "11": "Delhi", "12": "Haryana", "13": "Haryana", "14": "Punjab", "15": "Punjab", "16": "Punjab", "160": "Chandigarh", "17": "Himachal Pradesh", "18": "Jammu and Kashmir", "19": "Jammu and Kashmir", "194": "Ladakh",
    "20": "Uttar Pradesh", "21": "Uttar Pradesh", "22": "Uttar Pradesh", "23": "Uttar Pradesh", "24": "Uttar Pradesh", "25": "Uttar Pradesh", "26": "Uttar Pradesh", "27": "Uttar Pradesh", "28": "Uttar Pradesh",
    "244": "Uttarakhand", "246": "Uttarakhand", "247": "Uttarakhand", "248": "Uttarakhand", "249": "Uttarakhand", "262": "Uttarakhand", "263": "Uttarakhand",
    "2440": "Uttar Pradesh", "2441": "Uttar Pradesh", "2442": "Uttar Pradesh", "2443": "Uttar Pradesh", "2444": "Uttar Pradesh", "2445": "Uttar Pradesh", "2446": "Uttar Pradesh", "2448": "Uttar Pradesh", "2449": "Uttar Pradesh",
    "2470": "Uttar Pradesh", "2471": "Uttar Pradesh", "2472": "Uttar Pradesh", "2473": "Uttar Pradesh", "2474": "Uttar Pradesh", "2620": "Uttar Pradesh", "2621": "Uttar Pradesh", "2622": "Uttar Pradesh", "2623": "Uttar Pradesh", "2624": "Uttar Pradesh",
    "30": "Rajasthan", "31": "Rajasthan", "32": "Rajasthan", "33": "Rajasthan", "34": "Rajasthan", "36": "Gujarat", "37": "Gujarat", "38": "Gujarat", "39": "Gujarat", "3962": "Dadra and Nagar Haveli and Daman and Diu",
    "40": "Maharashtra", "41": "Maharashtra", "42": "Maharashtra", "43": "Maharashtra", "44": "Maharashtra", "403": "Goa", "45": "Madhya Pradesh", "46": "Madhya Pradesh", "47": "Madhya Pradesh", "48": "Madhya Pradesh", "49": "Chhattisgarh",
    "50": "Telangana", "51": "Andhra Pradesh", "52": "Andhra Pradesh", "53": "Andhra Pradesh", "5333": "Puducherry", "56": "Karnataka", "57": "Karnataka", "58": "Karnataka", "59": "Karnataka",
    "60": "Tamil Nadu", "61": "Tamil Nadu", "62": "Tamil Nadu", "63": "Tamil Nadu", "64": "Tamil Nadu", "605": "Puducherry", "6098": "Puducherry", "67": "Kerala", "68": "Kerala", "69": "Kerala", "6731": "Puducherry", "682": "Kerala", "6825": "Lakshadweep",
    "70": "West Bengal", "71": "West Bengal", "72": "West Bengal", "73": "West Bengal", "74": "West Bengal", "737": "Sikkim", "744": "Andaman and Nicobar Islands", "75": "Odisha", "76": "Odisha", "77": "Odisha", "78": "Assam",
    "790": "Arunachal Pradesh", "791": "Arunachal Pradesh", "792": "Arunachal Pradesh", "793": "Meghalaya", "794": "Meghalaya", "795": "Manipur", "796": "Mizoram", "797": "Nagaland", "798": "Nagaland", "799": "Tripura",
    "80": "Bihar", "81": "Bihar", "82": "Bihar", "83": "Bihar", "84": "Bihar", "85": "Bihar", "814": "Jharkhand", "815": "Jharkhand", "816": "Jharkhand", "825": "Jharkhand", "826": "Jharkhand", "827": "Jharkhand", "828": "Jharkhand", "829": "Jharkhand",
    "831": "Jharkhand", "832": "Jharkhand", "833": "Jharkhand", "834": "Jharkhand", "835": "Jharkhand",
}
