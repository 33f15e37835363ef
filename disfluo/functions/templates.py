"""Sentence templates and the values of their slots."""

from __future__ import annotations

# They must equal the published lists for the template source to give the same sentences.
SLOTS = {
    "name": "Sarah|John|Michael|Emily|David|Rachel|Daniel|Laura|Kevin|Anna|Peter|Maria|Tom|Julia|Chris|Nina|Omar|Priya|Hannah|Marcus",
    "doc": "report|invoice|contract|summary|proposal|agenda|memo|draft",
    "day": "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday",
    "month": "January|February|March|April|June|July|August|September|October|November|December",
    "time": "nine|ten|eleven|twelve|two|three|four|five",
    "part_of_day": "morning|afternoon|evening",
    "room": "office|kitchen|garage|basement|hallway|lobby|warehouse|studio",
    "colour": "red|blue|green|black|white|yellow|purple|orange",
    "object": "folder|binder|laptop|box|envelope|notebook|parcel",
    "channel": "email|message|call|text|letter",
    "count": "two|three|four|five|six|eight|ten|twelve",
    "number": "2|3|4|5|6|8|10|12|14|15|20|21|24|30",
    "topic": "budget|launch|migration|hiring plan|renewal|audit|field trip|rollout",
    "place": "the station|the airport|the clinic|the school|the main entrance|the north gate|the front desk",
    "adj": "large|small|quiet|upstairs|downstairs|corner",
    "status": "ready|late|signed|approved|still open|on hold",
    "task": "renew the licence|book the flights|order more paper|return the keys|confirm the numbers|update the slides|chase the supplier|back up the drive",
}
TEMPLATES = (
    "Send the {doc} to {name} before {day}.",
    "Send {name} the {colour} {object} from the {room}.",
    "Forward the {doc} to {name} and {name2}, please.",
    "Schedule the {topic} review for {day} at {time}.",
    "Schedule a {count}-hour session on {month} {number}.",
    "Remind me to {task} on {day} {part_of_day}.",
    "Remind {name} that the {doc} is {status}.",
    "Tell {name} the {doc} is {status} and needs a second look.",
    "Ask {name} whether the {doc} for the {topic} is {status}.",
    "Book a table for {count} people at {time} on {day}.",
    "Book the {adj} meeting room for {day} {part_of_day}.",
    "Move the {colour} {object} from the {room} to the {room2}.",
    "Move the {topic} meeting to {month} {number}.",
    "Email {name} about the {topic} and copy {name2}.",
    "Reply to {name} and say the {doc} will be ready by {day}.",
    "Call {name} at {time} and confirm the {doc}.",
    "Print {count} copies of the {doc} and leave them in the {room}.",
    "Order {number} more boxes of paper for the {room}.",
    "Cancel the {day} {part_of_day} call with {name}.",
    "Push the {topic} deadline back to {month} {number}.",
    "Add {name} to the {topic} thread and drop {name2} from it.",
    "Pick up the {object} from {place} on {day}.",
    "Meet {name} at {place} at {time} on {day}.",
    "File the signed {doc} under the {topic} and tell {name}.",
    "Draft a short {channel} to {name} about the {topic}.",
    "Confirm with {name} that the {adj} {room} is free on {day}.",
    "Let {name} know the {doc} arrived on {month} {number}.",
    "Check whether {name} sent the {doc} before {day} {part_of_day}.",
    "Bring the {colour} {object} to {place} by {time}.",
    "Split the {doc} into {count} sections and send it to {name}.",
    "Tell {name} I like the new {doc}.",
    "The {adj} {room} is free, so book it for {day}.",
    "Something like the {colour} {object} would work well.",
    "Ask {name} whether they know the {topic} figures.",
    "No one has signed the {doc} yet, so chase {name}.",
    "Say I am sorry to {name} about the {day} {part_of_day} call.",
    "Wait for {name} at {place} and bring the {doc}.",
    "That is right, the {doc} is due on {month} {number}.",
)
# End of the fixed values.

VALUES = {name: tuple(text.split("|")) for name, text in SLOTS.items()}
