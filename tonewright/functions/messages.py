"""What people are told, as tables. All of it is fixed values: the sentences, the words that lead to
them, and the order in which rules are tried."""

from __future__ import annotations

# Fixed values. Errors of a download: words, how many of them the message has to hold, what is said,
# and how many signs of the message follow.
DOWNLOAD_ERRORS = (
    (("private video", "sign in"), 1, "that video is private or requires sign-in", 0),
    (("video unavailable", "removed"), 1, "that video is unavailable or has been removed", 0),
    (("is not a valid url", "unsupported url"), 1, "not a URL that can be handled: ", 150),
    (("age", "confirm"), 2, "that video is age-restricted and needs sign-in", 0),
    (("403", "forbidden"), 1, "the site refused the request (HTTP 403): ", 200),
    (("http error 4", "http error 5"), 1, "the site refused the request: ", 150),
    ((), 0, "download failed: ", 300),
)

# Fixed values. Stages of a run in plain words; the stages of ECHOED say what their message says.
STATUS = {
    "upload": "sending the file",
    "gpu": "separating the parts on a free GPU",
    "prepare": "getting the audio ready",
    "separate": "separating the parts",
    "download": "fetching the models, kept for next time",
    "models": "fetching the models, kept for next time",
    "drums": "writing down the drums",
    "transcribe": "writing down the notes",
    "tempo": "finding the tempo",
    "merge": "lining the notes up with the beat",
    "grid": "lining the notes up with the beat",
}
ECHOED = ("online", "queue")
WRITING_A_PART = "writing down the %s"

# Fixed values. What tells a used-up quota from other failures, and the time to wait, as patterns.
QUOTA = r"(?i)quota|exceeded your|gpu (?:task|duration).*(?:abort|limit)|no gpu (?:was )?available"
WAIT = r"(?i)try again in\s+([0-9:]+)"

# Fixed values. A download button: with no part on, with all, with up to FEW of them, with more.
FEW = 3
BUTTON_NONE, BUTTON_ALL = "Switch a part on to download it", "Download all parts as MIDI"
BUTTON_FEW, BUTTON_MANY = "Download the %s as MIDI", "Download %s parts as MIDI"
